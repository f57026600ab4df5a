"""The registered queries: operators bound to tables, with the same question in SQL for checking."""
