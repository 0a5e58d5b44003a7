"""Watching a codebase: change events, debounce, incremental maintenance."""
