"""Every query over the driver's tables, with its SQL."""

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("graphs", "analytics", "contents", "stores"):
    _module = import_module(f"ashlar.catalog.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

#: Columns whose width DuckDB's literals and ranks would give otherwise.
_WIDTHS = {
    "INTEGER": {"g30_layers": ["place"], "w02_top_rules": ["rank"]},
    "BIGINT": {
        "k05_clear": ["nodes", "edges"], "a07_file_complexity": ["over"], "a08_semantic_metrics": ["cyclomatic", "cognitive"], "a10_module_digest": ["classes", "functions", "complex"],
        "a12_go_packages": ["files", "error_checks"], "u01_rule_engine": ["n"], "u18_recomputed_summary": ["n"], "e02_analyzer": ["n"], "s01_tree": ["n"], "s18_git_log": ["commits", "authors"],
        "p16_analysis": ["n"], "u06_selection": ["n"], "e09_adapter": ["edges"],
    },
}
for _kind, _columns in _WIDTHS.items():
    for _name, _own in _columns.items():
        ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {_kind}) AS {c}' for c in _own)}) FROM ({ORACLES[_name]})"

#: Queries that read no table, with typed answers: programs gives their like over the tables, tests keep these.
FIXED: dict = {}
_programs = import_module("ashlar.catalog.programs")
for _name in _programs.QUERIES:
    if _name in QUERIES:
        FIXED[_name] = QUERIES[_name], ORACLES[_name]
QUERIES |= _programs.QUERIES
ORACLES |= _programs.ORACLES
