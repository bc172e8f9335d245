"""Errors carry the exit code of the command line."""


class TabqError(Exception):
    code = 1


class UsageError(TabqError):
    code = 1


class CsvError(TabqError):
    code = 2


class SqlError(TabqError):
    code = 3
