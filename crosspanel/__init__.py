"""Panel-factor analytics and corpus operators as Spark DataFrame functions."""
