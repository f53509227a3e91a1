"""Part of the fleet analytics library: functions."""
