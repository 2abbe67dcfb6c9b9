import pytest

from qaloom.functions.prompts import TEMPLATES, filled
from qaloom.operators import generation, relations
from qaloom.operators.guards import RelationError


def test_stages_and_batches(spark):
    stages = [(n, lambda n=n: n.upper()) for n in ("a", "b", "c", "d")]
    assert generation.run_stages(stages, "b", "c") == {"b": "B", "c": "C"}
    for first, last in (("c", "b"), ("x", "c")):
        with pytest.raises(RelationError):
            generation.run_stages(stages, first, last)
    ran = []

    def run(batch):
        ran.append(batch)
        return spark.range(batch * 10)

    assert generation.batches_until(run, lambda df: df.count(), 55, 9, {2: spark.range(5)}) == [(1, 10), (2, 15), (3, 45), (4, 85)] and ran == [1, 3, 4]
    counts, lacking = relations.stage_counts({"s": {"a": spark.range(3), "b": None}, "t": {"a": spark.range(2)}})
    assert {r.stage: (r.n, r.shards) for r in counts.collect()} == {"s": (3, 1), "t": (2, 1)} and lacking == ["s/b"]


def test_every_template_takes_its_slots(spark):
    import re

    for kind, names in TEMPLATES.items():
        for name, template in names.items():
            slots = set(re.findall(r"\{(\w+)\}", template))
            out = spark.range(1).select(filled(kind, name, **dict.fromkeys(slots, "{doc}")).alias("x")).first().x
            assert out == re.sub(r"\{\w+\}", "{doc}", template)
    with pytest.raises(KeyError):
        filled("solve", "basic", docs="x")
