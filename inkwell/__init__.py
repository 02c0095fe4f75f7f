"""inkwell: Spark batch jobs that build, search and evaluate a documentation corpus."""
