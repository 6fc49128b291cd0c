"""Composed plans: the query catalog, pipelines and the action facade."""
