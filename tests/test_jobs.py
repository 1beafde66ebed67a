"""The jobs on small copies: runs again, growing input, failures on the way, command lines."""

import json
import logging
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from jobs import contact_cohort, link_graph
from jobs.common import settings

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
POINTS = "vec_id long, embedding array<double>, label string"


def cloud(n=60):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(0, 0.25) for _ in range(6)], ["007", "b"][i % 2]) for i in range(n)]
    return rows, [(900, [math.nan] * 6, "b"), (901, [1.0, 2.0], "b"), (902, None, "b"), (None, [0.1] * 6, "b"), (903, [0.1] * 6, None), (904, [math.inf] * 6, "007")]


def plain_cohort(rows, radius=0.8):
    out = {}
    for system in {s for *_, s in rows}:
        own = {i: [10 * x for x in v] for i, v, s in rows if s == system}
        near = {i: [j for j in own if j != i and math.dist(own[i][:3], own[j][:3]) <= radius] for i in own}
        seed = min((-len(n), i) for i, n in near.items() if n)[1]
        frame, queue = {seed: 0}, deque([seed])
        while queue:
            i = queue.popleft()
            for j in near[i]:
                if j not in frame:
                    frame[j] = frame[i] + 1
                    queue.append(j)
        for i in own:
            out[system, i] = (len(near[i]), frame.get(i, -1), round(math.dist(own[i][:3], own[i][3:6]), 6), len(own), sum(map(len, near.values())), seed, len(frame), max(frame.values()))
    return out


def got_cohort(df):
    return {(r.system, r.id): (r.degree, r.frame, r.disp, r.n_nodes, r.n_edges, r.seed, r.reached, r.max_frame) for r in df.collect()}


def test_cohort_equals_plain_one_and_runs_again(spark, tmp_path, caplog):
    rows, bad = cloud()
    spark.createDataFrame(rows + bad, POINTS).write.parquet(str(tmp_path / "points"))
    config = {"input": str(tmp_path / "points"), "output": str(tmp_path / "out")}
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    with caplog.at_level(logging.INFO, "contact_cohort"):
        first = got_cohort(contact_cohort.run(spark, config))
    assert first == plain_cohort(rows)
    said = [r.getMessage() for r in caplog.records]
    assert f"read {len(rows) + len(bad)} points of {config['input']}, {len(bad)} left out" in said and f"wrote {len(rows)} rows to {config['output']}/nodes" in said
    assert got_cohort(contact_cohort.run(spark, config)) == first
    assert sorted(os.listdir(tmp_path / "out" / "nodes"))[-2:] == ["system=007", "system=b"]
    # one system alone, of other points: the other system's partitions stay
    spark.createDataFrame([(i, [x / 2 for x in v], s) for i, v, s in rows], POINTS).write.parquet(str(tmp_path / "closer"))
    again = got_cohort(contact_cohort.run(spark, config | {"input": str(tmp_path / "closer"), "systems": ["b"]}))
    want = plain_cohort([(i, [x / 2 for x in v], s) for i, v, s in rows])
    assert again == {k: (want if k[0] == "b" else first)[k] for k in first}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_cohort_of_large_systems_neither_moves_nor_reads_contacts(spark, tmp_path, monkeypatch):
    from tessera.operators import traverse

    rows, bad = cloud()
    spark.createDataFrame(rows + bad, POINTS).write.parquet(str(tmp_path / "points"))
    stays, written, read = [], contact_cohort._write, []
    monkeypatch.setattr(contact_cohort, "_write", lambda df, path, keys, kind="parquet", stay=False: (stays.append((os.path.basename(path), stay)), written(df, path, keys, kind, stay))[1])
    monkeypatch.setattr(contact_cohort, "_read", lambda spark, df, path, *kind, f=contact_cohort._read: (read.append(os.path.basename(path)), f(spark, df, path, *kind))[1])
    monkeypatch.setattr(contact_cohort, "LARGE", 1)
    monkeypatch.setattr(traverse, "KERNEL_EDGES", 1)
    config = {"input": str(tmp_path / "points"), "output": str(tmp_path / "out")}
    assert got_cohort(contact_cohort.run(spark, config)) == plain_cohort(rows)
    assert stays == [("contacts", True), ("nodes", False), ("report", False)] and read == ["nodes", "report"]
    assert spark.read.parquet(str(tmp_path / "out" / "contacts")).count() == sum(n for *_, n in {(k[0], v[4]) for k, v in plain_cohort(rows).items()})


def test_cohort_aligns_where_asked(spark, tmp_path):
    rows, _ = cloud(40)
    turned = [(i, [*v[:3], -v[1] + 3, v[0] - 2, v[2] + 1], s) for i, v, s in rows]
    spark.createDataFrame(turned, POINTS).write.parquet(str(tmp_path / "points"))
    out = contact_cohort.run(spark, {"input": str(tmp_path / "points"), "output": str(tmp_path / "out"), "align": "kabsch"})
    assert {r.disp for r in out.collect()} == {0.0} and {r.verdict for r in out.collect()} == {None}
    with pytest.raises(ValueError, match="align"):
        contact_cohort.run(spark, {"input": str(tmp_path / "points"), "output": str(tmp_path / "out"), "align": "other"})


def test_cohort_without_points(spark, tmp_path):
    spark.createDataFrame([], POINTS).write.parquet(str(tmp_path / "points"))
    assert contact_cohort.run(spark, {"input": str(tmp_path / "points"), "output": str(tmp_path / "out")}).collect() == []


PAGES = [
    (1, "http://a.org/x?q=1", '<a href="/p">1</a><a href="/p#top">2</a><a href="q">3</a><a href="#here"></a><a href="mailto:me@a.org">m</a>'),
    (2, "https://b.net", '<a href="//a.org/p"></a><a href="http://a.org/p"></a><a href="javascript:x()"></a><a href=""></a>'),
    (3, None, '<a href="/p">'), (4, "http://a.org/y", None), (5, "no address", '<a href="/p">'), (6, "http://a.org/z", "no links"),
]
MORE = [(7, "http://a.org/w", '<a href="/p"><a href="/r">'), (8, "http://c.io/", '<a href="http://c.io/s?x=1#y"><a href="HTTP://c.io/t">'), (1, "http://a.org/x", '<a href="/p">')]


def plain_links(pages):
    n, who = Counter(), defaultdict(set)
    for _, url, html in pages:
        m = re.match(link_graph.SITE, url or "")
        for h in re.findall('href="([^"#]+)', html or "") if m else []:
            dst = h if re.match("[A-Za-z][A-Za-z0-9+.-]*:", h) else url.split(":")[0] + ":" + h if h.startswith("//") else m[0] + h if h.startswith("/") else m[0] + "/" + h
            if re.match("https?://[^/]", dst):
                n[dst] += 1
                who[dst].add(re.match("[^?#]*", url)[0])
    return {(re.match(link_graph.SITE, d)[0], d, n[d], len(who[d])) for d in n}


def add(spark, pages, folder):
    spark.createDataFrame(pages, link_graph.PAGES).coalesce(1).write.mode("append").parquet(folder)


def targets(df):
    return {(r.site, r.dst, r.n_links, r.degree) for r in df.collect()}


def links_config(tmp_path):
    return {"input": str(tmp_path / "pages"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark"), "buckets": 4}


def test_link_graph_takes_only_what_is_new(spark, tmp_path, caplog):
    config = links_config(tmp_path)
    add(spark, PAGES, config["input"])
    with caplog.at_level(logging.INFO, "link_graph"):
        assert targets(link_graph.run(spark, config)) == plain_links(PAGES)
        once = [r.getMessage() for r in caplog.records]
        assert targets(link_graph.run(spark, config)) == plain_links(PAGES)  # nothing is new
        idle = [r.getMessage() for r in caplog.records][len(once) :]
        add(spark, MORE, config["input"])
        assert targets(link_graph.run(spark, config)) == plain_links(PAGES + MORE)
        more = [r.getMessage() for r in caplog.records][len(once) + len(idle) :]
    assert once[0].startswith(f"batch 0: read {len(PAGES)} pages, wrote ") and len(idle) == 1
    assert more[0].startswith(f"batch 1: read {len(MORE)} pages, wrote ")
    assert {r.batch for r in spark.read.schema(link_graph.LINKS).parquet(config["output"] + "/links").collect()} == {0, 1}
    with pytest.raises(ValueError, match="4 buckets, not 8"):
        link_graph.run(spark, config | {"buckets": 8})


def test_link_graph_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    config = links_config(tmp_path)
    add(spark, PAGES, config["input"])
    link_graph.run(spark, config)
    add(spark, MORE, config["input"])

    def fails(links):
        raise RuntimeError("lost on the way")

    with monkeypatch.context() as m:
        m.setattr(link_graph, "targets_of", fails)  # the batch's links are written, its targets aren't
        with pytest.raises(Exception, match="lost on the way"):
            link_graph.run(spark, config)
    assert targets(link_graph.run(spark, config)) == plain_links(PAGES + MORE)
    assert not spark.streams.active


def test_link_graph_of_a_single_file_and_of_pages_without_links(spark, tmp_path):
    config = links_config(tmp_path)
    add(spark, [(6, "http://a.org/z", "no links")], config["input"])
    assert link_graph.run(spark, config).collect() == []
    (one,) = [f for f in os.listdir(config["input"]) if f.endswith(".parquet")]
    single = config | {"input": f"{config['input']}/{one}", "output": str(tmp_path / "out2"), "checkpoint": str(tmp_path / "mark2")}
    assert link_graph.run(spark, single).collect() == []


def test_settings():
    assert settings({"a": None, "b": 2, "c": 1.5}, {"a": "x", "c": 2}) == {"a": "x", "b": 2, "c": 2}
    for given, message in (({"a": 1, "d": 1}, "unknown"), ({}, "missing"), ({"a": 1, "b": "x"}, "a int is needed")):
        with pytest.raises(ValueError, match=message):
            settings({"a": None, "b": 2}, given)


def test_command_line(spark, tmp_path):
    config = links_config(tmp_path)
    add(spark, PAGES, config["input"])
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"buckets": 4}))
    call = [sys.executable, f"{ROOT}/jobs/link_graph.py", "--config", str(own), *[x for k in ("input", "output", "checkpoint") for x in (f"--{k}", config[k])]]
    done = subprocess.run(call, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0, done.stderr
    assert f"read {len(PAGES)} pages" in done.stderr
    assert targets(link_graph.table(spark, config["output"] + "/targets", link_graph.TARGETS)) == plain_links(PAGES)
    bad = subprocess.run([sys.executable, f"{ROOT}/jobs/contact_cohort.py", "--input", "x"], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert bad.returncode != 0 and "missing settings: ['output']" in bad.stderr
