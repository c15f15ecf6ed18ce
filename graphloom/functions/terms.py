"""RDF terms as strings, and the columns derived from them.

A term keeps its full text: ``<iri>``, ``_:label``, ``"text"``, ``"text"@lang``
or ``"text"^^<datatype>``. Terms are equal when their texts are.
"""

from __future__ import annotations

import base64
import gzip

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = f"<{RDF}type>"
SUB_CLASS_OF, SUB_PROPERTY_OF = f"<{RDFS}subClassOf>", f"<{RDFS}subPropertyOf>"
LABEL = f"<{RDFS}label>"

_LITERAL = r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$'


def iri(text: str) -> str:
    return f"<{text}>"


def literal(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def kind(term: Column) -> Column:
    """iri, bnode or literal."""
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").when(term.startswith('"'), "literal")


def lexical(term: Column) -> Column:
    """The text without brackets, quotes, language and datatype."""
    body = F.regexp_extract(term, _LITERAL, 1)
    plain = F.replace(F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    return F.when(term.startswith('"'), F.when(body.contains("\\"), plain).otherwise(body)).when(term.startswith("<"), F.substring(term, 2, 1 << 30).substr(F.lit(1), F.char_length(term) - 2)).otherwise(term)


def language(term: Column) -> Column:
    return F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1)


def datatype(term: Column) -> Column:
    """The datatype IRI of a literal; xsd:string if it names none, null for other terms."""
    named = F.regexp_extract(term, r'"\^\^(<[^>]*>)$', 1)
    return F.when(term.startswith('"'), F.when(named != "", named).otherwise(f"<{XSD}string>"))


def number(term: Column) -> Column:
    """A literal's text as double, null if it is none. Never fails on other text."""
    return F.when(term.startswith('"'), lexical(term).try_cast("double"))


def compress_text(text: str) -> str:
    return base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()


def decompress_text(text: str) -> str:
    return gzip.decompress(base64.b64decode(text)).decode()
