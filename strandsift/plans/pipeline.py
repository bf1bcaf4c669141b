"""Streams and senders: small lazy wrappers, piped with |, that run when asked to.

A stream here is a DataFrame (bounded or streaming); a sender is work that hasn't begun. A sender completes in one of three ways: with a value,
done without one, or with an error. Errors are told once. Items() pulls a stream batch by batch: next() is a sender of the next one, or done at the
end, cleanup() a sender that lets go of what the stream holds; sinks clean up at the end and after errors.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


class Receiver(Protocol):
    def set_value(self, *values: Any) -> None: ...

    def set_done(self) -> None: ...

    def set_error(self, error: BaseException) -> None: ...


class Closure:
    """target | closure calls it; closure | closure is one that calls both."""

    def __init__(self, function: Callable, *args: Any) -> None:
        self.function, self.args = function, args

    def __call__(self, target: Any) -> Any:
        return self.function(target, *self.args)

    def __ror__(self, target: Any) -> Any:
        return self(target)

    def __or__(self, other: Closure) -> Closure:
        return Closure(lambda target: other(self(target)))


def make_closure(function: Callable, *args: Any) -> Closure:
    return Closure(function, *args)


class Operation:
    """A sender and its receiver."""

    def __init__(self, sender: Sender, receiver: Receiver) -> None:
        self.sender, self.receiver = sender, receiver

    def start(self) -> None:
        try:
            values = self.sender.work()
        except Exception as error:
            self.receiver.set_error(error)
            return
        if values is None:
            self.receiver.set_done()
        else:
            self.receiver.set_value(*values)


class Sender:
    """work() gives the values as a tuple, or None if it ends without one."""

    def __init__(self, work: Callable[[], tuple | None]) -> None:
        self.work = work

    def connect(self, receiver: Receiver) -> Operation:
        return Operation(self, receiver)


def connect(sender: Sender, receiver: Receiver) -> Operation:
    return sender.connect(receiver)


def start(operation: Operation) -> None:
    operation.start()


def make_sender(function: Callable, *args: Any) -> Sender:
    return Sender(lambda: (function(*args),))


def ready_done_sender() -> Sender:
    return Sender(lambda: None)


def then(function: Callable) -> Closure:
    """Maps a sender's value. Of a function that gives None the value is empty."""

    def after(sender: Sender) -> Sender:
        def work() -> tuple | None:
            values = sender.work()
            if values is None:
                return None
            result = function(*values)
            return () if result is None else (result,)

        return Sender(work)

    return Closure(after)


class _Last:
    def __init__(self) -> None:
        self.values: tuple | None = None
        self.error: BaseException | None = None

    def set_value(self, *values: Any) -> None:
        self.values = values

    def set_done(self) -> None:
        pass

    def set_error(self, error: BaseException) -> None:
        self.error = error


def run(sender: Sender) -> Any:
    """Runs a sender here and now: its value, a tuple of several, or None. Raises its error."""
    last = _Last()
    start(connect(sender, last))
    if last.error is not None:
        raise last.error
    return last.values[0] if last.values and len(last.values) == 1 else last.values or None


def make_stream(source: DataFrame | Iterable, spark: SparkSession | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """A table as it is, or the rows of an iterable."""
    if isinstance(source, DataFrame):
        return source
    return (spark or SparkSession.getActiveSession()).createDataFrame(list(source), schema)


def transform_stream(function: Callable[[DataFrame], DataFrame] | dict[str, Column]) -> Closure:
    """Maps a stream: by a function of DataFrames, or by columns to add, one row for one row."""
    return Closure(lambda stream: stream.withColumns(function) if isinstance(function, dict) else stream.transform(function))


class Items:
    """A bounded stream, pulled from the driver: rows in lists of at most `size`, of which one is held at a time."""

    def __init__(self, stream: DataFrame, size: int = 1000, on_cleanup: Callable[[], None] | None = None) -> None:
        self.stream, self.size, self.on_cleanup, self.rows, self.clean = stream, size, on_cleanup, None, False

    def next(self) -> Sender:
        def work() -> tuple | None:
            if self.clean:
                return None
            if self.rows is None:
                self.rows = self.stream.toLocalIterator()
            found = list(itertools.islice(self.rows, self.size))
            return (found,) if found else None

        return Sender(work)

    def cleanup(self) -> Sender:
        """Its work is done once, whoever asks again."""

        def work() -> None:
            if not self.clean:
                self.clean, self.rows = True, None
                if self.on_cleanup is not None:
                    self.on_cleanup()

        return Sender(work)


def next_of(items: Items) -> Sender:
    return items.next()


def cleanup(items: Items) -> Sender:
    return items.cleanup()


def for_each_stream(function: Callable[[DataFrame], None], marks: str | None = None, on_cleanup: Callable[[], None] | None = None) -> Closure:
    """A sender that gives the stream to function until it ends: a table at once, a stream batch by batch (marks: its checkpoint folder). Its value is empty.

    Of Items, function gets each list of rows. on_cleanup is called when the stream has ended, also by an error, before the sender completes.
    """

    def drained(stream: DataFrame | Items) -> Sender:
        def each() -> None:
            if isinstance(stream, Items):
                while (found := stream.next().work()) is not None:
                    function(*found)
            elif not stream.isStreaming:
                function(stream)
            else:
                writer = stream.writeStream.foreachBatch(lambda batch, _: function(batch)).trigger(availableNow=True)
                query = (writer.option("checkpointLocation", marks) if marks else writer).start()
                try:
                    query.awaitTermination()
                finally:
                    query.stop()

        def work() -> tuple:
            try:
                each()
            finally:
                if isinstance(stream, Items):
                    stream.cleanup().work()
                if on_cleanup is not None:
                    on_cleanup()
            return ()

        return Sender(work)

    return Closure(drained)
