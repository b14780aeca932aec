"""Turtle against N-Triples of the same graph, however the file is cut."""

import pandas as pd
import pyarrow as pa
import pytest

from twinweave.plans.kg import derived
from twinweave.sources import files, turtle

TURTLE = '''@prefix ex: <http://e/> . @prefix : <http://d/x.> .
@base <http://base/dir/> .
# a comment. with dots . and "quotes"
ex:a a ex:Thing ; ex:name "Bob. \\"B\\"\\n"@en-GB , 'it''s'^^ex:t ;
  ex:note """long . text
 with <iri> . and ex:p "one" . # no comment
 ""quotes"" \\u00e9 end.""" ;; .
ex:a.b ex:p 1.5 , 2 , -3e4 , true .
<rel#x> ex:p <http://abs/y>.<http://e/z>ex:q :c.
PREFIX ex2: <http://two/>
ex2:k ex:p ex2:v . _:n ex:p [ ex:q "in" ; ex:r [] ] .
ex:list ex:p ( "a" ex:b ) .
ex:empty ex:p \'\'\'it\'s . """ not closed
here\'\'\' .
@prefix ex: <http://new/> .
ex:a ex:p ex:é, ex:\\~t .
[ ex:q ex:o ] ex:p "z" . [ ex:q ex:o2 ] .
'''
TURTLE = TURTLE.replace("'it''s'", "'it is'")


def rows(df):
    return sorted(map(tuple, df.select("s", "p", "o", "o_kind").collect()))


def spelled(found):
    """Blank nodes renamed by the order of their names."""
    blank = sorted({x for r in found for x in (r[0], r[2]) if x.startswith("_:")})
    return sorted(tuple(f"_:{blank.index(x)}" if x in blank else x for x in r) for r in found)


def expected():
    e, d, t = "http://e/", "http://d/x.", turtle.RDF
    lit, uri = "lit", "uri"
    plain = [
        (e + "a", t + "type", e + "Thing", uri), (e + "a", e + "name", 'Bob. "B"\n', lit), (e + "a", e + "name", "it is", lit),
        (e + "a", e + "note", 'long . text\n with <iri> . and ex:p "one" . # no comment\n ""quotes"" é end.', lit),
        (e + "a.b", e + "p", "1.5", lit), (e + "a.b", e + "p", "2", lit), (e + "a.b", e + "p", "-3e4", lit), (e + "a.b", e + "p", "true", lit),
        ("http://base/dir/rel#x", e + "p", "http://abs/y", uri), (e + "z", e + "q", d + "c", uri), ("http://two/k", e + "p", "http://two/v", uri),
        (e + "empty", e + "p", 'it\'s . """ not closed\nhere', lit), ("http://new/a", "http://new/p", "http://new/é", uri), ("http://new/a", "http://new/p", "http://new/~t", uri),
    ]
    return sorted(plain)


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_turtle_cut_anywhere(spark, tmp_path, size):
    """Splits of 300 bytes, some of which begin inside long literals, give the result of one split."""
    (tmp_path / "a.ttl").write_text(TURTLE)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        found = rows(turtle.read_turtle(spark, f"file://{tmp_path}/a.ttl", 1))
        broken = turtle.broken_statements(spark, f"file://{tmp_path}/a.ttl").count()
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(k) if k not in kept else spark.conf.set(k, kept[k])
    assert broken == 0
    assert [r for r in found if not any(x.startswith("_:") for x in r)] == expected()
    blank = [r for r in found if any(x.startswith("_:") for x in r)]
    assert len(blank) == 3 + 5 + 2 + 1 and len({x for r in blank for x in (r[0], r[2]) if x.startswith("_:")}) == 7


def by_splits(cuts):
    """The statements of TURTLE where splits begin at the given bytes: a line is in the split that its first byte is in."""
    data, at, lines = TURTLE.encode(), 0, []
    for line in data.split(b"\n"):
        lines.append(("f", max(c for c in cuts if c <= at), line.decode()))
        at += len(line) + 1

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(len(rows[0]))], [str(i) for i in range(len(rows[0]))])

    states = pd.concat([b.to_pandas() for b in turtle._split_states(iter([batch(lines)]))])
    begins = {r.split: (r.state, r.before) for r in turtle._strung(states).itertuples()}
    given = [(f, c, *begins[c], line) for f, c, line in lines]
    found = {}
    for b in turtle._cut_lines(iter([batch(given)])):
        for r in b.to_pylist():
            found.setdefault(r["n"], []).append((r["split"], r["text"], r["whole"]))
    assert all(len(v) == 1 for v in found.values() if v[0][2])
    return [(n, "\n".join(t for _, t, _ in sorted(v)).strip()) for n, v in sorted(found.items())]


def test_statements_of_a_file_cut_at_every_byte():
    want = by_splits([0])
    assert len(want) == 15
    for k in range(1, len(TURTLE.encode())):
        assert by_splits([0, k]) == want, k
    every = list(range(len(TURTLE.encode())))
    assert by_splits(every) == want


def test_broken_statements_are_counted(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://e/> .\ne:a e:p e:b .\nno:prefix e:p e:b .\n\"lit\" e:p e:b .\ne:a e:p .\ne:c e:p \"x\\q\" .\ne:d e:p e:e .\ne:open e:p e:f")
    (tmp_path / "b.ttl").write_text("# nothing but this\n\n")
    (tmp_path / "c.ttl").write_text("")
    assert rows(turtle.read_turtle(spark, f"file://{tmp_path}/*.ttl", 1)) == [("http://e/a", "http://e/p", "http://e/b", "uri"), ("http://e/d", "http://e/p", "http://e/e", "uri")]
    found = turtle.broken_statements(spark, f"file://{tmp_path}/*.ttl").orderBy("n").collect()
    assert [r.n for r in found] == [2, 3, 4, 5, 7] and all(r.error for r in found)


def test_turtle_equals_ntriples(spark, tmp_path):
    """One graph in both forms, with every escape that both have."""
    odd = [("http://e/a", "http://e/p", v, "lit") for v in ("tab\there", "two\nlines", 'q"q', "back\\slash", "C:\\new\\table", "é日🙂", "", "cr\rx", "end\\", '"', "a ' b . c", '"""')]
    data = [(1, *r) for r in [*odd, ("http://e/a", "http://o/with#hash", "http://e/b.", "uri"), ("http://e/c-d", "http://e/p", "http://e/9x", "uri")]]
    triples = spark.createDataFrame(data, "kg int, s string, p string, o string, o_kind string")
    triples.select(files.ntriples_line(triples.o_kind).alias("value")).write.text(f"file://{tmp_path}/g.nt")
    turtle.write_turtle(triples, f"file://{tmp_path}/g.ttl", {"e": "http://e/", "o": "http://o/"}, 3)
    want = sorted(r[1:] for r in data)
    assert rows(turtle.read_turtle(spark, f"file://{tmp_path}/g.ttl", 1)) == want
    assert rows(files.read_ntriples(spark, f"file://{tmp_path}/g.nt", 1)) == want
    assert rows(turtle.read_turtle(spark, f"file://{tmp_path}/g.nt", 1)) == want  # N-Triples is Turtle


def test_rdf_folder_by_suffix(spark, sf_dir, tmp_path):
    data = derived(spark, sf_dir)
    files.write_rdf(data, f"file://{tmp_path}/d", form="ttl")
    again = files.read_rdf(spark, f"file://{tmp_path}/d")
    assert rows(again.triples) == rows(data.triples.distinct())
    assert sorted(map(tuple, again.alignment.collect())) == sorted(map(tuple, data.alignment.collect()))
