"""Operators of a training-data pipeline over document tables.

Conventions shared by every operator here: ``doc_id`` names a document; rows that repeat it
or have none are decided row by row, but for op8's own table, which decides by ``doc_id``; a
null text is an empty one; columns beyond those an operator reads are ignored or carried
untouched, whatever their names.
"""
