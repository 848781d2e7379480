"""tarn: retrieval, evaluation and corpus analytics as Spark DataFrame plans."""
