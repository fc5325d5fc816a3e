"""The service around collections."""

import json
import threading

import pytest

from facetry.plans import service as S
from facetry.request import SearchRequest
from facetry.schema import Field, SearchSchema
from facetry.sources.collection import Registry

SCHEMA = SearchSchema((Field("id", "STRING", key=True), Field("text", "STRING", searchable=True)))


def test_settings_come_from_the_environment():
    assert S.Settings.from_env({}) == S.Settings()
    assert S.Settings.from_env({"FACETRY_WORKERS": "3", "FACETRY_HEAP_SHARE": "0.5", "FACETRY_METRICS": "false"}) == S.Settings(workers=3, heap_share=0.5, metrics=False)
    with pytest.raises(ValueError):
        S.Settings.from_env({"FACETRY_QUEUE": "many"})


def test_breaker_collects_once_in_a_while():
    used, collected, now = [0.99], [], [0.0]
    breaker = S.Breaker(lambda: used[0], lambda: collected.append(now[0]), S.Settings(), clock=lambda: now[0])
    for at in (0.0, 10.0, 31.0):
        now[0] = at
        with pytest.raises(S.Exhausted):
            breaker.check()
    assert collected == [0.0, 31.0]
    used[0] = 0.5
    breaker.check()


def test_service(spark, tmp_path):
    registry, full = Registry(spark, str(tmp_path)), threading.Event()
    settings = S.Settings(workers=2, queue=1)
    service = S.Service(registry, settings, S.Breaker(lambda: 1.0 if full.is_set() else 0.1, lambda: None, settings))
    service.call("create", None, "notes", SCHEMA.to_json())
    service.call("index", "notes", [{"document": json.dumps({"id": str(k), "text": "plain words"})} for k in range(3)], 1_700_000_000_000)
    found = [service.submit("search", "notes", SearchRequest(text_query="words")) for _ in range(5)]
    assert [f.result().total for f in found] == [3] * 5
    bad = service.submit("search", "missing", SearchRequest())
    assert S.code_of(bad.exception()) == S.INVALID_ARGUMENT and S.code_of(None) == S.OK and S.code_of(KeyError()) == S.INTERNAL
    full.set()
    assert service.health()["memory_breaker_open"] and service.health()["collections"]["notes"]["doc_count"] == 3
    assert S.code_of(service.submit("search", "notes", SearchRequest()).exception()) == S.EXHAUSTED
    assert service.call("count", "notes") == 3  # never refused
    text = service.metrics.text()
    assert 'facetry_requests_total{operation="search",outcome="OK"} 5' in text and 'outcome="RESOURCE_EXHAUSTED"} 1' in text
    assert 'facetry_request_seconds_count{operation="search"} 7' in text
    service.close()
    silent = S.Metrics(enabled=False)
    silent.record("search", "OK", 1.0)
    assert not silent.counts
