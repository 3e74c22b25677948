"""Spark-first analytics over component inventories, advisories and corpora."""
