"""The item query on a small hand-made model: missing attributes, repeated names, empty lists, cycles."""

import pytest

from girder.functions.patterns import translate
from girder.operators import query as q

ITEMS = [(1, "IFCWALL", "g1"), (2, "IFCWALLSTANDARDCASE", "g2"), (3, "IFCSLAB", None), (4, None, "g4"), (5, "IFCPROPERTYSET", "g5"), (6, "IFCPROPERTYSINGLEVALUE", None)]
ATTRIBUTES = [
    (1, 0, "Name", "string", "Wall A", None, None, "IFCLABEL"), (1, 1, "Name", "string", "Wall B", None, None, "IFCLABEL"), (2, 0, "Name", "number", None, 3.0, None, "IFCREAL"),
    (3, 0, "Name", "string", "3", None, None, "IFCLABEL"), (5, 0, "Name", "string", "Pset_Common", None, None, "IFCLABEL"),
    (6, 0, "Name", "string", "IsExternal", None, None, "IFCIDENTIFIER"), (6, 1, "NominalValue", "boolean", None, None, True, "IFCBOOLEAN"),
]
EDGES = [(1, "IsDefinedBy", 5), (5, "DefinesOccurrence", 1), (5, "HasProperties", 6), (2, "IsDefinedBy", 99)]


@pytest.fixture(scope="module")
def model(spark):
    heads = [(a, n) for a, n, _ in EDGES] + [(3, "IsDefinedBy")]
    return q.Model(
        spark.createDataFrame(ITEMS, "local_id long, category string, guid string"),
        spark.createDataFrame(ATTRIBUTES, "local_id long, ord int, name string, value_kind string, v_str string, v_num double, v_bool boolean, type string"),
        spark.createDataFrame(EDGES, "src_id long, name string, dst_id long"),
        spark.createDataFrame(heads, "src_id long, name string"),
    )


def ids(df):
    return sorted(r.local_id for r in df.collect())


A = q.Attribute
CASES = [
    (q.Query(), []),
    (q.Query(categories=()), []),
    (q.Query(categories=("WALL",)), [1, 2]),
    (q.Query(categories=("^IFCWALL$", "SLAB")), [1, 3]),
    (q.Query(local_ids=(1, 4), categories=("IFC",)), [1]),
    (q.Query(local_ids=()), []),
    (q.Query(attributes=()), []),
    (q.Query(attributes=(A("Name", "^Wall B$"),)), [1]),
    (q.Query(attributes=(A("^Name$", 3),)), [2]),
    (q.Query(attributes=(A("^Name$", "^3$"),)), [3]),
    (q.Query(attributes=(A("Nominal", True),)), [6]),
    (q.Query(attributes=(A("Nominal", False),)), []),
    (q.Query(attributes=(A(".", type="REAL"),)), [2]),
    (q.Query(attributes=(A("Name", ["A$", "Common"]),)), [1, 5]),
    (q.Query(attributes=(A("Name", negate=True),)), [4]),
    (q.Query(attributes=(A("Name", "A"), A("Name", "B"))), [1]),
    (q.Query(attributes=(A("Name", "Common"), A("Name", 3)), aggregation="inclusive"), [2, 5]),
    (q.Query(relation="IsDefinedBy"), [1, 2, 3]),
    (q.Query(relation="IsDefinedBy", target=q.Query(attributes=(A("Name", "Common"),))), [1]),
    (q.Query(relation="IsDefinedBy", target=q.Query()), []),
    (q.Query(categories=("WALL", "SLAB"), relation="IsDefinedBy", target=q.Query(attributes=(A("Name", "Common"),), relation="HasProperties", target=q.Query(attributes=(A("Name", "IsExternal"), A("NominalValue", True))))), [1]),
]


@pytest.mark.parametrize(("query", "expected"), CASES)
def test_item_query(model, query, expected):
    assert ids(q.item_query(model, query)) == expected


def test_maps_keep_the_last_of_equal_names(model):
    assert {r.local_id: r.attributes.get("Name") for r in q.attribute_map(model).collect()}[1] == "Wall B"


def test_unique_values_take_the_first_match(model):
    rows = q.unique_values(model, (q.UniqueSpec("^Name$"),)).collect()
    assert {(r.v_str or r.v_num): r.local_ids for r in rows} == {"Wall A": [1], 3.0: [2], "3": [3], "Pset_Common": [5], "IsExternal": [6]}


def test_patterns():
    assert translate("a[^]b", "i") == r"(?i)a[\s\S]b"
    with pytest.raises(ValueError):
        translate("a", "g")
