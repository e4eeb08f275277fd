"""All registered queries of the library and their SQL, by name."""

from tessera.plans import answers, base, deletions, domains, enrich, files, govern, hierarchies, joined, knowledge, pages, streams, versions

MODULES = (base, knowledge, govern, enrich, joined, pages, answers, hierarchies, versions, streams, deletions, domains, files)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
