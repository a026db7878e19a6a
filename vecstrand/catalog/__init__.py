"""The core queries: each a Spark plan over the operators, beside the SQL that states its answer."""
