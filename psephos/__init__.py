"""psephos: cohort analytics over large record tables, expressed as Spark DataFrame operators."""
