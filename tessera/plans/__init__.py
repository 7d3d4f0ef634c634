"""Orchestrations of operators: indexing a project, searching, answering."""
