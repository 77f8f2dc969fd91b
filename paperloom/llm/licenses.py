"""License notices inside documents.

Templates are short notices. Documents are cut into overlapping windows whose MinHash values
retrieve templates, and the exact share of a template's shingles in the document decides (see
``containment``). Words are compared in lower case; punctuation parts them.

Defined results: a null text holds nothing; documents with a null id are not reported; a template
is reported once per document, however often it stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperloom.llm.containment import contained

# The usual short notices, worded as their licenses publish them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("reserved", "All rights reserved."),
)
BREAK = r"[\x20\x09-\x0D.,;:()\"“”]+"


def plain_words(text: str) -> Column:
    """Words in lower case; punctuation parts them as blanks do."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "item_id long, license string, text string")


def scan(docs: DataFrame, notices: DataFrame) -> DataFrame:
    """(doc_id, template_id, license, shared, template_shingles) from ``notices`` (item_id, license, text)."""
    found = contained(docs, plain_words("text"), notices, plain_words("text"))
    return found.join(F.broadcast(notices.select("item_id", "license")), "item_id").select(
        "doc_id", F.col("item_id").alias("template_id"), "license", "shared", F.col("item_shingles").alias("template_shingles")
    )
