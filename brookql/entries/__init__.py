"""Registered queries by chapter: name -> (text in the flow language, SQL that must agree).

A text that begins with ``sql:`` is SQL input.  ``{sf}`` is the folder of the tables, ``{t}`` begins names of tables of one run and
``{tmp}`` is a folder of one run; results of texts with either are fetched (they are small), and what was written is removed.
"""
