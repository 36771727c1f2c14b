"""Catalog, fingerprint, diff and drift cases taken from the reference's unit tests."""

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import drift as D
from tessera.operators.catalog import SCHEMA_COLUMNS


def col(db, table, name, typ, ordinal=0, nullable=False, default=None, pk=False, uq=False, gen=False,
        enum=None, fk=None):
    return (db, table, ordinal, name, typ, None, nullable, default, pk, uq, gen, enum,
            fk[0] if fk else None, fk[1] if fk else None)


GOLDEN = ('{"enums":[],"tables":[{"name":"users","columns":[{"name":"email","type":"text","nullable":false,'
          '"isPrimary":false,"isUnique":false,"default":null,"foreignKey":null,"enum":null},{"name":"id","type":"uuid",'
          '"nullable":false,"isPrimary":false,"isUnique":false,"default":null,"foreignKey":null,"enum":null}]}]}')


def test_fingerprint_golden(spark):
    cols = spark.createDataFrame([col("d", "users", "id", "uuid", 1), col("d", "users", "email", "text", 2)],
                                 SCHEMA_COLUMNS)
    doc = C.canonical_schema_json(cols).collect()[0].canonical_json
    assert doc == GOLDEN
    import hashlib
    fp = C.schema_fingerprint(cols).collect()[0]
    assert fp.fingerprint == hashlib.sha256(GOLDEN.encode()).hexdigest()
    assert fp.short_id == fp.fingerprint[:12]


def test_fingerprint_order_independent(spark):
    a = spark.createDataFrame([col("d", "users", "id", "uuid"), col("d", "orders", "id", "uuid")], SCHEMA_COLUMNS)
    b = spark.createDataFrame([col("d", "orders", "id", "uuid"), col("d", "users", "id", "uuid")], SCHEMA_COLUMNS)
    assert C.schema_fingerprint(a).collect()[0].fingerprint == C.schema_fingerprint(b.repartition(3)).collect()[0].fingerprint


def _diff(spark, old, new):
    o = spark.createDataFrame(old, SCHEMA_COLUMNS)
    n = spark.createDataFrame(new, SCHEMA_COLUMNS)
    ch = D.schema_diff(o, n)
    return o, n, ch, sorted((r.kind, r.table_name, r.column_name, r.detail) for r in ch.collect())


def test_diff_cases(spark):
    base = [col("d", "users", "id", "integer", pk=True), col("d", "users", "email", "text")]
    assert _diff(spark, base, base)[3] == []
    added = base + [col("d", "posts", "id", "integer")]
    assert _diff(spark, base, added)[3] == [("table_added", "posts", "", "")]
    assert _diff(spark, added, base)[3] == [("table_removed", "posts", "", "")]
    more = base + [col("d", "users", "nickname", "text", nullable=True)]
    assert _diff(spark, base, more)[3] == [("column_added", "users", "nickname", "text nullable=true")]
    changed = [col("d", "users", "id", "bigint", pk=True), col("d", "users", "email", "text", nullable=True)]
    got = _diff(spark, base, changed)[3]
    assert ("column_changed", "users", "id", "type changed integer -> bigint") in got
    assert ("column_changed", "users", "email", "nullable false -> true") in got


def test_fk_added_column_gives_two_rows_and_decision(spark):
    old = [col("d", "orders", "id", "integer"), col("d", "users", "id", "integer")]
    new = old + [col("d", "orders", "userId", "integer", fk=("users", "id"))]
    o, n, ch, rows = _diff(spark, old, new)
    assert ("fk_added", "orders", "userId", "users.id") in rows
    cls = {(r.kind, r.column_name): r.category for r in D.classify_drift(ch, o, n).collect()}
    assert cls[("fk_added", "userId")] == "decision"
    assert cls[("column_added", "userId")] == "decision"


def test_rename_and_drift_report(spark):
    old = [col("d", "users", "id", "integer"), col("d", "users", "fullName", "text")]
    new = [col("d", "users", "id", "integer"), col("d", "users", "name", "text")]
    o, n, ch, _ = _diff(spark, old, new)
    ren = D.detect_renames(ch, o, n).collect()
    assert [(r.column_name, r.from_column) for r in ren] == [("name", "fullName")]
    cls = D.classify_drift(ch, o, n)
    by = {r.column_name: (r.category, r.op) for r in cls.collect()}
    assert by["name"] == ("likely", "rename_column")
    assert by["fullName"] == ("auto", "drop_column")
    rep = D.drift_report(cls).collect()[0]
    assert rep.has_drift and not rep.auto_resolvable and not rep.needs_decision


def test_name_similarity_rules(spark):
    # prefix/suffix or length ratio >= 0.6, case-insensitive
    old = [col("d", "t", "k", "text"), col("d", "t", "abcdefghij", "text"), col("d", "t", "Email", "text")]
    new = [col("d", "t", "k", "text"), col("d", "t", "zzzzzz", "text"), col("d", "t", "emailAddress", "text")]
    o, n, ch, _ = _diff(spark, old, new)
    got = {r.column_name: r.from_column for r in D.detect_renames(ch, o, n).collect()}
    assert got["emailAddress"] == "Email"          # prefix
    assert got["zzzzzz"] == "Email"                 # 5/6 length ratio, first by name ("Email" < "abcdefghij")


def test_summary_text(spark):
    df = spark.createDataFrame([("d", "table_added"), ("d", "column_added"), ("d", "column_added"),
                                ("d", "fk_added"), ("e", "column_changed")], "db_id string, kind string")
    got = {r.db_id: r.summary for r in D.diff_summary(df).collect()}
    assert got == {"d": "+1 tbl +2 col", "e": "~1 col"}
    empty = D.diff_summary(df.where("false"), spark.createDataFrame([("x",)], "db_id string")).collect()[0]
    assert empty.summary == "-"


def test_default_strategy(spark):
    cases = [("now()", "timestamp", "timestamp"), ("CURRENT_TIMESTAMP", "timestamp with time zone", "timestamp"),
             ("gen_random_uuid()", "uuid", "uuid"), ("'active'::text", "text", "default"), ("0", "integer", "default"),
             ("now()", "text", "default")]
    df = spark.createDataFrame(cases, "d string, t string, want string")
    for r in df.select(C.default_strategy(F.col("d"), F.col("t")).alias("got"), "want").collect():
        assert r.got == r.want


def test_mysql_ddl_types(spark):
    cases = [("varchar", 100, "VARCHAR(100)"), ("character varying", None, "VARCHAR(255)"), ("text", None, "TEXT"),
             ("integer", None, "INT"), ("bigint", None, "BIGINT"), ("boolean", None, "TINYINT(1)"),
             ("numeric", None, "DECIMAL(18,6)"), ("timestamp with time zone", None, "DATETIME(6)"),
             ("uuid", None, "CHAR(36)"), ("jsonb", None, "JSON"), ("bytea", None, "BLOB"), ("point", None, "POINT")]
    df = spark.createDataFrame(cases, "t string, n int, want string")
    for r in df.select(C.mysql_column_ddl_type(F.col("t"), F.col("n")).alias("got"), "want").collect():
        assert r.got == r.want


def test_properties_fingerprint_shuffle_and_refresh_leaves_empty_diff(spark):
    """Fingerprint is invariant under row order / partitioning; applying the refresh plan's
    drop / rename / add to a catalog gives a catalog whose diff to the target has no column rows."""
    import random

    rng = random.Random(7)
    rows = [col("d", f"t{rng.randint(0, 4)}", f"c{i}", rng.choice(["text", "integer", "uuid"]), i,
                nullable=rng.random() < .5) for i in range(60)]
    a = spark.createDataFrame(rows, SCHEMA_COLUMNS)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    b = spark.createDataFrame(shuffled, SCHEMA_COLUMNS).repartition(7)
    assert C.schema_fingerprint(a).collect()[0].fingerprint == C.schema_fingerprint(b).collect()[0].fingerprint

    from tessera.operators.generate import apply_refresh_plan
    old = [col("d", "users", "id", "integer"), col("d", "users", "fullName", "text"), col("d", "users", "age", "integer")]
    new = [col("d", "users", "id", "integer"), col("d", "users", "name", "text"),
           col("d", "users", "nick", "text", nullable=True)]
    o, n, ch, _ = _diff(spark, old, new)
    plan = [r.asDict() for r in D.classify_drift(ch, o, n).collect()]
    data = spark.createDataFrame([(1, "Ann", 30)], "id int, fullName string, age int")
    out = apply_refresh_plan({"users": data}, plan)["users"]
    assert sorted(out.columns) == ["id", "name", "nick"]
    assert out.collect()[0].asDict() == {"id": 1, "name": "Ann", "nick": ""}


def test_structured_classification_fixes_text_rules(spark):
    old = [col("d", "t", "a", "text", uq=True), col("d", "t", "b", "text"), col("d", "t", "c", "bigint")]
    new = [col("d", "t", "a", "text"), col("d", "t", "b", "text", uq=True), col("d", "t", "c", "integer")]
    o = spark.createDataFrame(old, SCHEMA_COLUMNS)
    n = spark.createDataFrame(new, SCHEMA_COLUMNS)
    ch = D.diff_with_meta(o, n)
    text = {r.column_name: r.category for r in D.classify_drift(ch).collect()}
    fixed = {r.column_name: r.category for r in D.classify_drift(ch, compat=False).collect()}
    assert text == {"a": "decision", "b": "auto", "c": "likely"}       # the source's text rules
    assert fixed == {"a": "auto", "b": "decision", "c": "breaking"}    # direction-aware


def test_create_table_ddl(spark):
    rows = [("d", "users", 1, "id", "bigint", None, False, "nextval('users_id_seq'::regclass)", True, False, False,
             None, None, None),
            ("d", "users", 2, "email", "character varying", 120, False, None, False, True, False, None, None, None),
            ("d", "users", 3, "role", "enum", None, True, "'USER'::\"Role\"", False, False, False, "Role", None, None),
            ("d", "users", 4, "tags", "ARRAY", None, True, None, False, False, False, None, None, None)]
    cols = spark.createDataFrame(rows, SCHEMA_COLUMNS)
    pg = C.create_table_ddl(cols).first().ddl
    assert pg == ('CREATE TABLE "users" (\n  "id" BIGSERIAL NOT NULL,\n  "email" varchar(120) NOT NULL,\n'
                  '  "role" "Role" DEFAULT \'USER\'::"Role",\n  "tags" text[],\n  PRIMARY KEY ("id"),\n'
                  '  UNIQUE ("email")\n)')
    my_rows = [("d", "t", 1, "id", "bigint", None, False, "AUTO_INCREMENT", True, False, False, None, None, None),
               ("d", "t", 2, "ok", "boolean", None, True, "1", False, False, False, None, None, None)]
    my = C.create_table_ddl(spark.createDataFrame(my_rows, SCHEMA_COLUMNS), "mysql").first().ddl
    assert my == ("CREATE TABLE `t` (\n  `id` BIGINT AUTO_INCREMENT NOT NULL,\n  `ok` TINYINT(1) DEFAULT 1,\n"
                  "  PRIMARY KEY (`id`)\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4")


def test_assemble_schema_mysql(spark):
    cols = spark.createDataFrame([
        ("d", "users", "id", 1, "bigint", "bigint", "NO", None, "PRI", "auto_increment", None),
        ("d", "users", "email", 2, "varchar", "varchar(120)", "NO", None, "UNI", "", 120),
        ("d", "users", "role", 3, "enum", "enum('USER','ADMIN')", "NO", "USER", "", "", None),
        ("d", "users", "slug", 4, "varchar", "varchar(10)", "YES", None, "", "STORED GENERATED", 10),
        ("d", "posts", "author", 1, "bigint", "bigint", "NO", None, "MUL", "", None),
        ("d", "v_users", "id", 1, "bigint", "bigint", "NO", None, "", "", None)],
        "db_id string, table_name string, column_name string, ordinal_position int, data_type string, "
        "column_type string, is_nullable string, column_default string, column_key string, extra string, "
        "character_maximum_length long")
    kcu = spark.createDataFrame([("d", "posts", "author", "users", "id"), ("d", "users", "id", None, None)],
                                "db_id string, table_name string, column_name string, referenced_table_name string, "
                                "referenced_column_name string")
    tables = spark.createDataFrame([("d", "users", "BASE TABLE"), ("d", "posts", "BASE TABLE"), ("d", "v_users", "VIEW")],
                                   "db_id string, table_name string, table_type string")
    out, enums = C.assemble_schema_mysql(cols, kcu, tables)
    got = {(r.table_name, r.column_name): r for r in out.collect()}
    assert set(got) == {("users", "id"), ("users", "email"), ("users", "role"), ("users", "slug"), ("posts", "author")}
    assert got[("users", "id")].col_default == "AUTO_INCREMENT" and got[("users", "id")].is_primary
    assert got[("users", "email")].is_unique and got[("users", "email")].varchar_len == 120
    assert (got[("users", "role")].col_type, got[("users", "role")].enum_name) == ("enum", "users_role")
    assert got[("users", "slug")].is_generated and not got[("users", "role")].is_generated
    assert (got[("posts", "author")].fk_table, got[("posts", "author")].fk_column) == ("users", "id")
    assert sorted((r.enum_name, r.enum_value) for r in enums.collect()) == [("users_role", "ADMIN"), ("users_role", "USER")]
