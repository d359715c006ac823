from tallywright.sources.tables import (
    BONUSES,
    DONATIONS,
    PLAN,
    USERS,
    read_files,
    read_table,
    read_vacancies,
    vacancies_schema,
    write_bucketed,
)
from tallywright.sources.versions import VersionedTable, new_folder

__all__ = [
    "BONUSES",
    "DONATIONS",
    "PLAN",
    "USERS",
    "VersionedTable",
    "new_folder",
    "read_files",
    "read_table",
    "read_vacancies",
    "vacancies_schema",
    "write_bucketed",
]
