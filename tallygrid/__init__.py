"""tallygrid: a Spark-native document take-off and corpus-preparation engine."""
