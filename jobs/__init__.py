"""Runnable jobs on plain paths: python -m jobs.probe_screen, python -m jobs.repeat_mask."""
