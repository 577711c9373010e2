"""Part of sensorframe."""
