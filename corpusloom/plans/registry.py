"""All queries outside the llm subpackage."""

from corpusloom.plans import analysis, problems, reader, relations, reports, sources

_MODULES = (problems, reader, analysis, relations, reports, sources)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
