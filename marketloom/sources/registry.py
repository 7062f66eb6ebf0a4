"""The sources by name: each reads its list pages and its detail pages. SQL reaches page trees by a table function."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cards as C
from . import details as D
from .tree import ELEMENTS, PageElements


class SourceParser(Protocol):
    """What a source must offer. Pages carry page_id and html; detail pages also source_id."""

    name: str

    def parse_list(self, pages: DataFrame, next_year: int) -> DataFrame:
        """One row of the observation schema for each advert of each page."""

    def parse_detail(self, pages: DataFrame, next_year: int) -> DataFrame:
        """The pages with a struct column ``detail``."""


@dataclass(frozen=True)
class FlatSource:
    name: str
    cards: C.Flat
    details: D.Prose

    def parse_list(self, pages: DataFrame, next_year: int) -> DataFrame:
        return C.flat_cards(pages, self.cards, next_year)

    def parse_detail(self, pages: DataFrame, next_year: int) -> DataFrame:
        return D.prose_details(pages, self.details, next_year)


@dataclass(frozen=True)
class WrappedSource:
    name: str
    cards: C.Wrapped
    details: D.Sheet

    def parse_list(self, pages: DataFrame, next_year: int) -> DataFrame:
        return C.wrapped_cards(pages, self.cards, next_year)

    def parse_detail(self, pages: DataFrame, next_year: int) -> DataFrame:
        return D.sheet_details(pages, self.details, next_year)


@dataclass(frozen=True)
class EmbeddedSource:
    name: str
    cards: C.Embedded
    details: D.Record

    def parse_list(self, pages: DataFrame, next_year: int) -> DataFrame:
        return C.embedded_cards(pages, self.cards)

    def parse_detail(self, pages: DataFrame, next_year: int) -> DataFrame:
        return D.record_details(pages, self.details, next_year)


class Sources:
    """Parsers by name. A name is given once."""

    def __init__(self, *parsers: SourceParser) -> None:
        self.parsers: dict[str, SourceParser] = {}
        for p in parsers:
            self.add(p)

    def add(self, parser: SourceParser) -> None:
        if parser.name in self.parsers:
            raise ValueError(f"there is a source {parser.name} already")
        self.parsers[parser.name] = parser

    def get(self, name: str) -> SourceParser:
        if name not in self.parsers:
            raise KeyError(f"unknown source: {name}")
        return self.parsers[name]

    def parse_lists(self, pages: DataFrame, next_year: int, source_col: str = "source") -> DataFrame:
        """Adverts of pages of many sources, each read by its own parser. Pages of unknown sources are refused, not skipped."""
        out = None
        for name, parser in self.parsers.items():
            rows = parser.parse_list(pages.where(F.col(source_col) == name).drop(source_col), next_year)
            out = rows if out is None else out.unionByName(rows)
        unknown = pages.where(F.col(source_col).isNull() | ~F.col(source_col).isin(list(self.parsers)))
        refused = unknown.where(F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(source_col, F.lit("null")))).isNotNull())
        out = out.unionByName(refused.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields]))
        return out


def register(spark: SparkSession) -> None:
    """Makes page_elements(html) known to SQL, to be used with LATERAL."""
    spark.udtf.register("page_elements", F.udtf(PageElements, returnType=ELEMENTS, useArrow=True))
