"""factloom: a Spark-first engine for fact tables, rules, fixpoints and change feeds."""
