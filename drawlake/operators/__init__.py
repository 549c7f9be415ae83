"""Operators over entity tables.

For all of them: rows with a null box meet nothing and do not count for boxes; null and empty
texts are texts without words; rows that repeat a handle on a sheet are told apart by nothing
and may each be answered for the other; an empty table gives no rows; columns that an operator
does not name pass through or are left out, and names with a leading underscore are its own.
"""
