"""tidemark: product analytics for freemium apps, written as Spark DataFrame plans."""
