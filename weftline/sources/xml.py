"""XML: reads by path in the JVM, edits in Arrow batches."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def texts(document: Column, path: str) -> Column:
    """Texts of all nodes at an XPath."""
    return F.xpath(document, F.lit(f"{path}/text()"))


def apply_edit(document: str | None, edit: str, path: str, name: str = "", value: str = "") -> str | None:
    """One edit at every element of a path below the root (``.`` is the root); null for what isn't XML.

    ``set_text``, ``set_attribute``, ``delete_attribute``, ``insert`` (the element ``value``, once), ``delete``.
    """
    try:
        root = ET.fromstring(document or "")
    except ET.ParseError:
        return None
    if edit == "delete":
        gone = set(root.findall(path))
        for parent in root.iter():
            for child in [x for x in parent if x in gone]:
                parent.remove(child)
    for node in root.findall(path) if edit != "delete" else ():
        if edit == "set_text":
            node.text = value
        elif edit == "set_attribute":
            node.set(name, value)
        elif edit == "delete_attribute":
            node.attrib.pop(name, None)
        elif edit == "insert":
            new = ET.fromstring(value)
            if all(ET.tostring(x).strip() != ET.tostring(new).strip() for x in node):
                node.append(new)
        else:
            raise ValueError(edit)
    return ET.tostring(root, encoding="unicode")


def edited(document: Column, edit: str, path: str, name: str = "", value: str = "") -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: apply_edit(x, edit, path, name, value))

    return run(document)
