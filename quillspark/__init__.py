"""A PySpark-native engine for analysing and rewriting long documents at corpus scale."""
