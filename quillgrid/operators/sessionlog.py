"""Session events: services, recent documents, macros, recovery, reports, as tables of events."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import texts
from quillgrid.session import InvalidInput

RECENT = 20
#: Events that a session keeps.
KEPT = 500
#: Words of commands that change a document.
MUTATING = ("Set", "Insert", "Append", "Delete", "Add", "Create", "Update", "Remove", "Replace", "Execute")
#: Family of a file name's extension.
EXTENSIONS = {"txt": "text", "md": "text", "docx": "text", "odt": "text", "html": "text", "pdf": "text", "csv": "spreadsheet", "xlsx": "spreadsheet", "ods": "spreadsheet", "pptx": "presentation", "odp": "presentation", "odg": "drawing", "svg": "drawing", "odf": "formula", "mathml": "formula", "odb": "database"}


def recents(events: DataFrame, path: str = "path", ts: str = "ts", limit: int = RECENT) -> DataFrame:
    """The paths saved last, each once, newest first, at most ``limit``. Paths first, so only as many rows
    as there are paths are ordered."""
    return events.where(F.col(path).isNotNull()).groupBy(path).agg(F.max(ts).alias(ts)).orderBy(F.desc(ts), F.asc(path)).limit(limit)


def last_events(events: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    return events.orderBy(*(F.desc(k) for k in keys)).limit(limit)


def mutating(command: Column) -> Column:
    """Whether a command changes a document: its name begins with one of the changing words."""
    name = F.regexp_replace(command, r"\A\.uno:", "")
    return F.coalesce(name.rlike(rf"\A({'|'.join(MUTATING)})"), F.lit(False))


def kind_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, texts.ascii_lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)))


def macro(events: DataFrame, recorder: str, ts: str = "ts") -> DataFrame:
    """The commands of one recording in order: only those of the command scheme."""
    return events.where((F.col("recorder") == recorder) & F.col("command").startswith(".uno:")).select(F.row_number().over(W.partitionBy("recorder").orderBy(ts, "event_id")).alias("step"), "command")


def manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """Recovery manifest rows: six tab-separated fields, other lines are skipped."""
    fields = F.split(column, "\t")
    names = ("id", "kind", "title", "path", "autosave", "saved_at")
    return lines.where(F.size(fields) == 6).select(*(fields[k].alias(n) for k, n in enumerate(names)))


def transform(text: Column, how: str) -> Column:
    """Text services: uppercase, lowercase, titlecase, reverse."""
    found = {"uppercase": F.upper, "lowercase": F.lower, "titlecase": texts.title_case, "reverse": F.reverse}
    if how not in found:
        raise InvalidInput(f"no such transform: {how}")
    return found[how](text)


class Services:
    """Named services of Column functions. Singletons come before factories; every call is recorded as an
    event, told to the subscribers of its topic, and the function is registered with SQL."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.singletons: dict[str, Callable] = {}
        self.factories: dict[str, Callable[[], Callable]] = {}
        self.listeners: dict[int, tuple[str | None, Callable]] = {}
        self.events: deque[tuple[int, str, str]] = deque(maxlen=KEPT)
        self.count = 0

    def register(self, name: str, function: Callable) -> None:
        self.singletons[name] = function

    def register_factory(self, name: str, factory: Callable[[], Callable]) -> None:
        self.factories[name] = factory

    def subscribe(self, topic: str | None, listener: Callable) -> int:
        key = max(self.listeners, default=0) + 1
        self.listeners[key] = (topic, listener)
        return key

    def unsubscribe(self, key: int) -> bool:
        return self.listeners.pop(key, None) is not None

    def publish(self, source: str, topic: str) -> None:
        self.count += 1
        self.events.append((self.count, source, topic))
        for wanted, listener in list(self.listeners.values()):
            if wanted in (None, topic):
                listener(source, topic)

    def invoke(self, name: str, method: str, *args):
        service = self.singletons.get(name) or (self.factories[name]() if name in self.factories else None)
        if service is None:
            raise InvalidInput(f"service not found: {name}")
        out = service(method, *args)
        self.publish(name, method)
        return out

    def event_log(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.events), "event_id long, source string, topic string")
