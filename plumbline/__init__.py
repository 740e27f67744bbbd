"""A Spark-first engine for camera calibration tables: geometry expressions, grouped solvers, and a training-data toolbox."""
