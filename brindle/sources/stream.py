"""A paged interface, polled as a stream.

Pages are named by tokens, and each page names the next one. An offset is the
token of the page that comes next, with the tokens of the pages since the offset
before: the checkpoint of a query so holds all that a restart needs, and a batch
that is replayed asks for the same pages. Only tokens pass through the driver;
each page is asked for in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from brindle.operators.crowd import RECORD
from brindle.sources.readers import import_function

#: The offset's token where the last page has been given out.
END = ""


class PageToken(InputPartition):
    def __init__(self, token: str | None) -> None:
        super().__init__(token)


class PagedStream(DataSource):
    """Options: ``client``, an importable ``module:function`` from a token to (rows of
    the schema, token of the next page).

    ``peek``, a function from a token to the next token alone: None while the page
    is not there or still grows, "" if it is the last. Without it the driver asks
    ``client`` and lets the rows go, so pages are fetched twice, and a page without a
    next token is the last. ``first``: the token of the first page (None unless
    given). ``pages_per_batch``: most pages of a batch (100).
    """

    @classmethod
    def name(cls) -> str:
        return "brindle_paged_stream"

    def schema(self):
        return self.options.get("schema", RECORD)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStreamReader(dict(self.options))


class PagedStreamReader(DataSourceStreamReader):
    """Spark tells a restarted reader where it stands by an empty range of offsets,
    so what this object remembers is only what the checkpoint says."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.most = int(options.get("pages_per_batch", 100))
        if self.most < 1:
            raise ValueError("pages_per_batch must be positive")
        self.at: dict | None = None

    def _next(self, token: str | None) -> str | None:
        if "peek" in self.options:
            return import_function(self.options["peek"])(token)
        return import_function(self.options["client"])(token)[1] or END

    def initialOffset(self) -> dict:
        return {"n": 0, "next": self.options.get("first"), "pages": {}}

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        token, pages = at["next"], {}
        while token != END and len(pages) < self.most:
            following = self._next(token)
            if following is None:
                break
            pages[str(len(pages))] = token
            token = following
        # Without a new page the offset stays as it is, so no empty batch runs.
        return {"n": at["n"] + len(pages), "next": token, "pages": pages} if pages else at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        if start["n"] == end["n"]:
            return []
        if end["n"] - start["n"] != len(end["pages"]):
            raise ValueError("the offsets of a batch do not follow each other")
        return [PageToken(end["pages"][str(k)]) for k in range(len(end["pages"]))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from import_function(self.options["client"])(partition.value)[0]
