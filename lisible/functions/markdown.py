"""Markdown paragraph rewrite: images moved to the end of their paragraph.

Paragraphs are separated by runs of two or more newlines, and a run of
``#`` right after a newline also starts a paragraph (the marks themselves
are dropped). Each paragraph loses its images, gets a blank line and its
images (blank-line separated) appended, and paragraphs are re-joined with
a blank line — so plain paragraphs end up four newlines apart. The split
is done by marking (no look-behind) so RE2 can run the same patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lisible.functions.text import ESCAPE, ESCAPED

PARA_MARK = ESCAPE + "\ue004"   # the escape character is escaped in the text first, so texts that hold it come back
IMAGE = "!\\[[^\\n]*?\\]\\([^\\n]*?\\)"
BLANK_RUN = "\\n{2,}"
HEADING_AFTER = "(\\n|" + PARA_MARK + ")#+"
SEP = "\n\n"


def paragraphs(text: Column) -> Column:
    marked = F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED)), BLANK_RUN, PARA_MARK)
    marked = F.regexp_replace(marked, HEADING_AFTER, "$1" + PARA_MARK)
    return F.split(marked, PARA_MARK)


def relocate_images(text: Column) -> Column:
    def one(p: Column) -> Column:
        images = F.regexp_extract_all(p, F.lit(IMAGE), 0)
        return F.concat(F.regexp_replace(p, IMAGE, ""), F.lit(SEP), F.array_join(images, SEP))
    return F.replace(F.array_join(F.transform(paragraphs(text), one), SEP), F.lit(ESCAPED), F.lit(ESCAPE))
