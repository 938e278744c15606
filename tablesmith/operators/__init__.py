"""Table operators: functions from DataFrame (and parameters) to DataFrame."""
