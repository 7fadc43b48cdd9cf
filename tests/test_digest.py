"""Digests with fields, settings, chains and flows, on small code."""

from corpuscle.operators import digest, extract, graph, outline

SHOP = '''from app.pay.card import Card

LIMIT = 10

class Order(Base):
    total: int = 0

@router.get("/orders/{id}")
def get_order(id: int):
    return Card(id)
'''
PAY = "from app.bank.wire import Wire\n\n" + "".join(f"A{i:02d} = {i}\n" for i in range(9)) + "".join(f"\n\nclass M{i:02d}(Base):\n    n{i}: int = 0\n" for i in range(10))


def sections(spark, files):
    nodes, edges = extract.nodes(files), extract.edges(files)
    chains = graph.two_hop(spark.createDataFrame([("shop", "pay"), ("pay", "bank")], "src string, dst string"))
    flows = outline.flow_targets(extract.key_flows(files), edges, files.select("repo_id", "file_path"))
    rows = outline.full_digest(digest.modules(files.selectExpr("*", "'' AS summary")), outline.precise_symbols(nodes), outline.model_fields(files), outline.config_values(files), chains, flows)
    return {(r.part, r.module): r.digest for r in rows.collect()}


def test_sections(spark):
    rows = [("r", "app/shop/order.py", "python", SHOP), ("r", "app/pay/card.py", "python", PAY), ("r", "app/bank/wire.py", "python", "x = 1\n")]
    got = sections(spark, spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string"))
    assert got["chains", ""] == "## chains\nshop -> pay -> bank"
    assert got["flows", ""] == "## flows\nAPI GET /orders/{id} (app/shop/order.py) -> pay"
    assert got["module", "shop"].split("\n")[-2:] == ["fields: Order: total(int)", "settings: LIMIT=10"]
    assert got["module", "bank"] == "## bank (1 files)"
    fields, settings = got["module", "pay"].split("\n")[-2:]
    assert fields.count("; ") == 7 and fields.startswith("fields: M00: n0(int); M01: n1(int)")
    assert settings == "settings: " + "; ".join(f"A{i:02d}={i}" for i in range(6))


def test_no_files(spark):
    none = spark.createDataFrame([], "repo_id string, file_path string, language string, content string")
    assert [k for k in sections(spark, none) if k[0] == "module"] == []


CONFIG = '''import os

class Settings(BaseSettings):
    """All settings."""
    name: str = "shop",
    _hidden: int = 1
    _OPEN: int = 2
    key: Optional[str] = None
    plain: int
    long: str = "''' + "x" * 60 + '''"

    def load(self):
        late: int = 3

LIMIT = 10
KIND = Type[int]
'''


def test_settings_class(spark):
    """Fields of the class before its first method come before constants; underscored names only in capitals; ten in all."""
    rows = [("r", "a.py", "python", CONFIG), ("r", "b.py", "python", "".join(f"A{i:02d} = {i}\n" for i in range(12))), ("r", "c.py", "python", None), ("r", "d.py", "python", "class Settings():")]
    files = spark.createDataFrame(rows, "repo_id string, file_path string, language string, content string")
    got = {}
    for r in outline.config_values(files).orderBy("file_path", "pos").collect():
        got.setdefault(r.file_path, []).append(r.setting)
    assert got["a.py"] == ['name="shop"', "_OPEN=2", "key=None", 'long="' + "x" * 39 + "...", "LIMIT=10"]
    assert got["b.py"] == [f"A{i:02d}={i}" for i in range(10)] and set(got) == {"a.py", "b.py"}
