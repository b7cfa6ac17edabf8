"""Part of a Spark-native engine for penalised predictive modelling and inference."""
