"""The main text of web pages, by a recurrent labeller of their blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailcast.llm.block_labeller import Shape, Weights, fit, label_pages
from retailcast.llm.html_blocks import Block, blocks_of
from retailcast.llm.html_layouts import layouts


@dataclass(frozen=True)
class Settings:
    shape: Shape = Shape()
    # The labeller is trained on so many generated pages, which no input table changes.
    layouts: int = 1500
    epochs: int = 8
    seed: int = 1
    # Characters of pages that are held as blocks at once; a longer page is held alone.
    chars: int = 1 << 21


@cache
def trained(settings: Settings = Settings()) -> Weights:
    """Weights of the labeller; the same settings give the same weights, once per process."""
    pages, labels = layouts(settings.layouts, settings.seed)
    return fit(pages, labels, settings.shape, settings.epochs)


def _texts(pages: list[list[Block]], weights: Weights, shape: Shape) -> list[str]:
    kept = label_pages(pages, weights, shape)
    return [" ".join(b.text for b, keep in zip(page, labels) if keep) for page, labels in zip(pages, kept)]


def main_text(source: str | None, settings: Settings = Settings()) -> str:
    """The main text of one page."""
    return _texts([blocks_of(source)], trained(settings), settings.shape)[0]


def _extracted(weights: Weights, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(2)
            first, held = 0, 0
            pages: list[list[Block]] = []
            for i in range(batch.num_rows):
                source = sources[i].as_py()
                pages.append(blocks_of(source))
                held += len(source or "")
                if held > settings.chars or i == batch.num_rows - 1:
                    texts = _texts(pages, weights, settings.shape)
                    columns = [batch.column(c).slice(first, len(pages)) for c in (0, 1)]
                    lengths = pa.array([len(t) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])
                    first, held, pages = i + 1, 0, []

    return run


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    The text is the blocks that the labeller takes for the article, in page order, joined by one blank;
    scripts, styles, comments in the markup and form controls are no blocks. References are decoded, and
    runs of white space inside a block become one blank. Null and empty pages, and pages without an
    article, have an empty text. Pages of any length are read whole, and their blocks judged in one
    sequence. Each row is worked on by itself: repeated rows give repeated results, ids and addresses may
    be null. An empty table gives an empty result. Other columns, whatever their names, are not read. Ids are
    whole numbers. One pass, without a shuffle.
    """
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(_extracted(trained(settings), settings), "page_id long, url string, text string, n_chars long")
