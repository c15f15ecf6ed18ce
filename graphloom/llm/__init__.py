"""Training-corpus operators. Nothing outside this subpackage imports it.

Conventions shared by every operator: input columns are named by parameters and
only those are read, so extra columns (whatever their names) never clash; a null
text counts as the empty text; duplicate or null ids are ordinary rows unless an
operator's docstring says otherwise; an empty table gives an empty result with
the same schema.
"""
