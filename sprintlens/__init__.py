"""sprintlens: effort analytics over change history, written for Spark."""
