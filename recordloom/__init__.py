"""Spark jobs that turn collections of structured documents into coded, linked, validated records."""
