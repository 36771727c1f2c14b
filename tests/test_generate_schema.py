"""Generated data of whole schemas: keys, references and domains hold, and every run gives the same rows."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators import generate_schema as G
from tessera.operators import integrity as I
from tessera.operators.catalog import SCHEMA_COLUMNS

# An application schema of 16 tables (PK primary key, U unique, ? nullable, > reference, enum name in brackets).
TIMES = "createdAt timestamp without time zone, updatedAt timestamp without time zone"
TABLES = {
    "Address": "id text PK, street text, city text, state text?, country text, zipCode text, profileId text U >Profile.id",
    "Attachment": "id text PK, filename text, url text, size integer, mimeType text, postId text >Post.id",
    "Category": "id text PK, name text U, description text?, parentId text?",
    "Comment": "id text PK, content text, postId text >Post.id, authorId text >User.id, parentId text?",
    "MenuItem": "id text PK, name text, path text?, icon text?, order integer, parentId text?",
    "Notification": "id text PK, type enum [NotificationType], title text, content text, read boolean, userId text >User.id",
    "Organization": "id text PK, name text U, description text?, logo text?",
    "OrganizationMember": "id text PK, role enum [OrgRole], userId text >User.id, organizationId text >Organization.id",
    "Post": "id text PK, title text, content text, published boolean, viewCount integer, authorId text >User.id, projectId text >Project.id",
    "Profile": "id text PK, bio text?, dateOfBirth timestamp without time zone?, address text?, socialLinks json?, userId text U >User.id",
    "Project": "id text PK, name text, description text?, status enum [ProjectStatus], organizationId text >Organization.id, teamId text? >Team.id",
    "Reaction": "id text PK, type enum [ReactionType], userId text >User.id, postId text? >Post.id, commentId text? >Comment.id",
    "Tag": "id text PK, name text U, color text?",
    "Team": "id text PK, name text, description text?, organizationId text >Organization.id",
    "TeamMember": "id text PK, role enum [TeamRole], userId text >User.id, teamId text >Team.id, replacedById text? U",
    "User": "id text PK, email text U, name text?, password text, role enum [Role], status enum [UserStatus], preferences json?, managerId text?",
}
ENUMS = {"NotificationType": ["MENTION", "COMMENT", "REACTION", "TEAM_INVITE", "PROJECT_UPDATE"], "OrgRole": ["OWNER", "ADMIN", "MEMBER"],
         "ProjectStatus": ["ACTIVE", "ARCHIVED", "COMPLETED"], "ReactionType": ["LIKE", "LOVE", "HAHA", "WOW", "SAD", "ANGRY"], "Role": ["USER", "ADMIN"],
         "TeamRole": ["LEADER", "MEMBER"], "UserStatus": ["ACTIVE", "INACTIVE", "SUSPENDED"]}


def columns(tables):
    out = []
    for table, text in tables.items():
        for ordinal, part in enumerate(text.split(", ")):
            name, rest = part.split(" ", 1)
            fk = rest.split(">")[1].split(".") if ">" in rest else (None, None)
            enum = rest.split("[")[1].split("]")[0] if "[" in rest else None
            flags = rest.split(">")[0].split()
            kind = rest.split(">")[0].split("[")[0].replace(" PK", "").replace(" U", "").replace("?", "").strip()
            size = int(kind.split("(")[1][:-1]) if "(" in kind and "varchar" in kind else None
            out.append(Row(db_id="db", table_name=table, ordinal=ordinal, column_name=name, col_type=kind, varchar_len=size, nullable="?" in rest, col_default=None,
                           is_primary="PK" in flags, is_unique="U" in flags, is_generated="GEN" in flags, enum_name=enum, fk_table=fk[0], fk_column=fk[1]))
    return out


def check(schema, frames, enums):
    """Violations of any kind, as texts."""
    found = []
    for table, df in frames.items():
        cols = [c for c in schema if c.table_name == table]
        keys = [c.column_name for c in cols if c.is_primary]
        unique = [c.column_name for c in cols if c.is_unique]
        found += [str(r) for r in I.key_violations(df, table, keys, unique).collect()]
        needed = [c.column_name for c in cols if not c.nullable and not c.is_generated]
        found += [str(r) for r in I.null_violations(df, table, needed).collect()]
        allowed = {c.column_name: enums[c.enum_name] for c in cols if c.enum_name}
        lengths = {c.column_name: c.varchar_len for c in cols if c.varchar_len}
        if allowed or lengths:
            found += [str(r) for r in I.domain_violations(df, table, allowed, lengths).where("violations > 0").collect()]
        for c in cols:
            if c.fk_table:
                found += [str(r) for r in I.fk_violations(df, table, c.column_name, frames[c.fk_table], c.fk_table, c.fk_column).limit(3).collect()]
    return found


def test_sixteen_tables_keep_their_constraints(spark):
    schema = columns({t: f"{c}, {TIMES}" for t, c in TABLES.items()})
    rows = {t: 500 + 37 * i for i, t in enumerate(sorted(TABLES))} | {"User": 1500, "Profile": 1200, "Address": 1200, "Organization": 7}
    frames = G.generate_schema(spark, spark.createDataFrame(schema, SCHEMA_COLUMNS), rows, ENUMS)
    order = list(frames)
    assert all(order.index(c.fk_table) < order.index(c.table_name) for c in schema if c.fk_table and not c.nullable)
    frames = {t: df.cache() for t, df in frames.items()}
    assert {t: df.count() for t, df in frames.items()} == rows
    assert check(schema, frames, ENUMS) == []
    nulls = frames["Project"].where("teamId is null").count()
    assert 0 < nulls < rows["Project"] / 4
    again = G.generate_schema(spark, spark.createDataFrame(schema, SCHEMA_COLUMNS), rows, ENUMS)["Post"]
    assert again.exceptAll(frames["Post"]).isEmpty()


def test_composite_keys_self_references_and_short_columns(spark):
    tables = {"a": "id integer PK, code varchar(3) U, boss integer? >a.id", "b": "id integer PK >a.id, note varchar(5)",
              "ab": "a integer PK >a.id, b integer PK >b.id, weight numeric", "abn": "a integer PK >a.id, nr integer PK, gen text GEN",
              "chain": "id integer PK, next integer? U >chain.id, up integer >chain.id"}
    schema = columns(tables)
    rows = {"a": 900, "b": 800, "ab": 700_00, "abn": 4000, "chain": 50}
    frames = G.generate_schema(spark, spark.createDataFrame(schema, SCHEMA_COLUMNS), rows)
    assert {t: df.count() for t, df in frames.items()} == rows
    assert check(schema, frames, {}) == []
    assert frames["a"].where("boss >= id").isEmpty() and frames["a"].where("boss is null").count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutations_reach_every_number_once(spark, n):
    got = [r.p for r in spark.range(n).select(G.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))


def test_impossible_schemas_are_errors(spark):
    def run(tables, rows, enums=None):
        return G.generate_schema(spark, spark.createDataFrame(columns(tables), SCHEMA_COLUMNS), rows, enums)

    with pytest.raises(ValueError, match="need each other"):
        run({"a": "id integer PK, b integer >b.id", "b": "id integer PK, a integer >a.id"}, {"a": 1, "b": 1})
    with pytest.raises(ValueError, match="unique references"):
        run({"a": "id integer PK", "b": "id integer PK, a integer U >a.id"}, {"a": 3, "b": 4})
    with pytest.raises(ValueError, match="unique rows"):
        run({"a": "id integer PK, e enum U [E]"}, {"a": 3}, {"E": ["x", "y"]})
    with pytest.raises(ValueError, match="characters"):
        run({"a": "id integer PK, c varchar(1) U"}, {"a": 40})
    with pytest.raises(ValueError, match="number of rows"):
        run({"a": "id integer PK"}, {})
    with pytest.raises(ValueError, match="no rows"):
        run({"a": "id integer PK", "b": "id integer PK, a integer >a.id"}, {"a": 0, "b": 1})
