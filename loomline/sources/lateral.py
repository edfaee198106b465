"""Parsers as table functions for SQL: one document, many rows, by LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import parsers


def _bytes(content: bytes | str | None) -> bytes:
    return content.encode() if isinstance(content, str) else bytes(content or b"")


class CodeSections:
    """code_sections(xml): position, title, section, heading, body of a code's sections."""

    def eval(self, xml: str) -> Iterator[tuple]:
        for i, row in enumerate(parsers.code_sections(_bytes(xml)) if xml else ()):
            yield i, *row


class ActSections:
    """act_sections(xml, act_type, year, number): position, act_title, section, heading, body of an act's sections."""

    def eval(self, xml: str, act_type: str, year: int, number: int) -> Iterator[tuple]:
        for i, row in enumerate(parsers.act_sections(_bytes(xml), act_type, year, number) if xml else ()):
            yield i, *row


class HtmlSection:
    """html_section(html, heading_tag, heading_class, body_tag, body_class): heading and body, if the page has any."""

    def eval(self, html: str, heading_tag: str, heading_class: str, body_tag: str, body_class: str) -> Iterator[tuple]:
        heading, body = parsers.html_section(html or "", parsers.HtmlRules(heading_tag, heading_class, body_tag, body_class))
        if heading or body:
            yield heading, body


FUNCTIONS = {
    "code_sections": (CodeSections, "position int, title string, section string, heading string, body string"),
    "act_sections": (ActSections, "position int, act_title string, section string, heading string, body string"),
    "html_section": (HtmlSection, "heading string, body string"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL: `SELECT ... FROM t, LATERAL code_sections(t.xml) AS s`."""
    for name, (handler, kinds) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=kinds))
