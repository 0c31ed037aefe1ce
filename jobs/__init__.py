"""Runnable jobs over the library; each module has ``run`` for a session and a command line."""
