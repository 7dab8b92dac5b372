"""Plans: the scene that the driver's tables stand for, the queries over it, and SQL for the same rows."""
