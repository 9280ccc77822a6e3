"""Loomwright: the data work around text-to-SQL models, as Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns DataFrames (or Columns); nothing is collected to the
driver except where a docstring gives the bound of what is collected.
"""
