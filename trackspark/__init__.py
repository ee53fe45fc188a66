"""trackspark: 3D+time object tracking analytics as Spark jobs."""
