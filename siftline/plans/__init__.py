"""Plan helpers: intermediate tables that outlive executors, and session settings."""
