"""The registered queries over the given tables, each with the SQL it is checked against."""

from quarrylight.plans import features, loadtest, models, profiling, requests, sampling

TOPICS = [profiling, sampling, features, requests, loadtest, models]


def all_queries() -> dict:
    return {name: query for topic in TOPICS for name, query in topic.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for topic in TOPICS for name, sql in topic.SQL.items()}
