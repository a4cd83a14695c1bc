"""Page-structure analytics and training-data operators on Spark."""
