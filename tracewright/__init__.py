"""A PySpark-native engine for evidence graphs and calibrated identification probabilities."""
