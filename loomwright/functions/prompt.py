"""Prompt text from nested schema records: the schema, the matched values, the question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.logits import let
from loomwright.functions.text import quote_identifier, strip

# The fixed words of the prompt format are spelled out below in the order in which they are printed.


def column_sequence(table: Column, column: Column) -> Column:
    """``table.column ( type | primary key | comment : … | values : … )``; absent parts are left out."""
    contents = column["contents"]
    facts = F.concat_ws(
        " | ",
        column["type"],
        F.when(column["pk"] != 0, F.lit("primary key")),
        F.when(column["comment"] != "", F.concat(F.lit("comment : "), column["comment"])),
        F.when(F.size(contents) > 0, F.concat(F.lit("values : "), F.array_join(contents, " , "))),
    )
    return F.concat(table, F.lit("."), quote_identifier(column["name"]), F.lit(" ( "), facts, F.lit(" )"))


def schema_sequence(items: Column, foreign_keys: Column) -> Column:
    """The schema as prompt text. Names are quoted on the way out, so rendering a record twice gives the same text."""

    def table_line(item: Column) -> Column:
        def line(table: Column) -> Column:
            columns = F.array_join(F.transform(item["columns"], lambda c: column_sequence(table, c)), " , ")
            return F.concat(F.lit("table "), table, F.lit(" , columns = [ "), columns, F.lit(" ]"))

        return let(quote_identifier(item["table_name"]), line)

    def edge_line(edge: Column) -> Column:
        source = F.concat_ws(".", quote_identifier(edge["src_table"]), quote_identifier(edge["src_column"]))
        target = F.concat_ws(".", quote_identifier(edge["ref_table"]), quote_identifier(edge["ref_column"]))
        return F.concat(source, F.lit(" = "), target)

    edges = F.when(
        F.size(foreign_keys) > 0,
        F.concat(F.lit("foreign keys :\n"), F.array_join(F.transform(foreign_keys, edge_line), "\n")),
    ).otherwise("foreign keys : None")
    lines = F.concat(F.array(F.lit("database schema :")), F.transform(items, table_line), F.array(edges))
    return let(F.array_join(lines, "\n"), strip)


def content_sequence(entries: Column) -> Column:
    """Matched values as prompt text. ``entries`` is an ordered array of ``(key, values)`` with key ``table.column``;
    whatever follows a second dot in the key is dropped."""

    def line(entry: Column) -> Column:
        names = F.transform(F.slice(F.split(entry["key"], r"\."), 1, 2), quote_identifier)
        name = F.coalesce(F.array_join(names, "."), F.lit(""))
        return F.concat(name, F.lit(" ( "), F.array_join(entry["values"], " , "), F.lit(" )"))

    lines = F.array_join(F.concat(F.array(F.lit("matched contents :")), F.transform(entries, line)), "\n")
    return let(F.when(F.size(entries) > 0, lines).otherwise("matched contents : None"), strip)


def prompt_prefix(schema: Column, contents: Column, text: Column) -> Column:
    return F.concat(schema, F.lit("\n"), contents, F.lit("\n"), text, F.lit("\n"))


def label_text(name: Column, comment: Column) -> Column:
    """``name ( comment ) `` with a trailing blank, or the bare name."""
    return F.when(comment != "", F.concat(name, F.lit(" ( "), comment, F.lit(" ) "))).otherwise(name)
