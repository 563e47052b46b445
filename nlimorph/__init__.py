"""Spark jobs for natural-language-inference experiments with metamorphic test variants."""
