"""Runnable jobs over the library: each has a function that takes a session, a config file and a command line."""
