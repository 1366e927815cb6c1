import json
import os
import sys
from datetime import UTC, datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spendscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def put(tmp_path):
    """Write a JSON document, JSON lines or plain text and return the path; folders are made."""

    def write(name: str, content) -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        if name.endswith(".jsonl"):
            path.write_text("".join((c if isinstance(c, str) else json.dumps(c)) + "\n" for c in content))
        else:
            path.write_text(content if isinstance(content, str) else json.dumps(content))
        return str(path)

    return write


#: A Monday; buckets begin so many hours after it.
MONDAY = datetime(2026, 8, 3, tzinfo=UTC)


def tokens_row(model, fresh, out=0, hits=None, writes=None, **more):
    """Result of the first vendor's completions export; ``fresh`` is all input, hits and writes included."""
    row = {"object": "organization.usage.completions.result", "model": model, "input_tokens": fresh, "output_tokens": out}
    return row | {k: v for k, v in (("input_cached_tokens", hits), ("input_cache_write_tokens", writes)) if v is not None} | more


def vectors_row(fresh, **more):
    return {"object": "organization.usage.embeddings.result", "model": "text-embedding-3-large", "input_tokens": fresh} | more


def hours_file(*rows, after=0, hours=24):
    """One page with one bucket of unix times."""
    begin = int((MONDAY + timedelta(hours=after)).timestamp())
    return {"data": [{"start_time": begin, "end_time": begin + 3600 * hours, "results": list(rows)}]}


def report_file(*rows, after=0, hours=24):
    """One page with one bucket of ISO times."""
    begin, end = (f"{MONDAY + timedelta(hours=after + h):%Y-%m-%dT%H:%M:%SZ}" for h in (0, hours))
    return {"data": [{"starting_at": begin, "ending_at": end, "results": list(rows)}]}


def claude_row(model, fresh, out=0, **more):
    """Result of the second vendor's usage report; ``fresh`` excludes what the cache gave or took."""
    return {"model": model, "uncached_input_tokens": fresh, "output_tokens": out} | more
