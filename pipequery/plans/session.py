"""Runs a pipeline's SQL: translates statements, and carries out on state tables what Spark tables can't do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipequery.dialect import Dialect, UnsupportedSQL, column_type, solid, split_statements, spaced, text_of, tokenize
from pipequery.operators.state import StateTable
from pipequery.shared import shared_folder

_NAME = r"[\w.\"`]+"


class SQLRunner:
    """``root``: the folder of state tables, shared by driver and executors. Statements run in the order given."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_folder(spark)}/state"
        self.tables: dict[str, StateTable] = {}
        self.attached: dict[str, dict[str, str]] = {}  #: catalog name: how to read its tables
        self.settings: dict[str, str] = {}
        self.frozen: dict[str, DataFrame] = {}  #: temporary tables

    def use(self, spark: SparkSession) -> None:
        """Run in another session from now on: that of a stream's batch is a copy with views of its own."""
        if spark is not self.spark:
            self.spark = spark
            for t in self.tables.values():
                t.spark = spark
                t.view()

    # --- names -----------------------------------------------------------------------------------

    @staticmethod
    def view_name(name: str) -> str:
        return re.sub(r"[\"`]", "", name).replace(".", "__").lower()

    def _dialect(self, now: str | None) -> Dialect:
        columns: dict[str, T.DataType] = {}
        for view in self.spark.catalog.listTables():
            if view.isTemporary:
                for f in self.spark.table(view.name).schema:
                    if not isinstance(columns.get(f.name.lower()), T.StructType):
                        columns[f.name.lower()] = f.dataType
        return Dialect(columns, {n.replace("__", "."): n for n in self.tables if "__" in n}, now)

    def table(self, name: str) -> StateTable:
        try:
            return self.tables[self.view_name(name)]
        except KeyError:
            raise ValueError(f"no table {name}") from None

    def attach(self, name: str, **options: str) -> None:
        """Tables of catalog ``name`` are read by ``spark.read.format(format)`` with these options; ``path`` is a folder of Parquet tables."""
        self.attached[name.lower()] = options

    # --- statements ------------------------------------------------------------------------------

    def run(self, sql: str, now: str | None = None, batch: tuple[str, int] | None = None) -> DataFrame | None:
        """All statements of ``sql``; the last one's rows, None if it gives none.

        ``now`` stands for now(). ``batch`` is (query, batch id): what a state table has of it already
        isn't applied again.
        """
        out = None
        for n, statement in enumerate(split_statements(sql)):
            out = self._one(statement, now, (f"{batch[0]}/{n}", batch[1]) if batch else None)
        return out

    def _one(self, statement: str, now: str | None, batch) -> DataFrame | None:
        flat = text_of(spaced(tokenize(statement)))
        head = [t.text.upper() for t in solid(tokenize(flat))[:4]]
        if head[0] in ("BEGIN", "COMMIT", "INSTALL", "LOAD", "USE", "CHECKPOINT"):
            return None  # each table changes by one swap, each swap knows its batch; there is nothing to load
        if head[0] == "SET":
            return self._set(flat)
        if head[0] == "ATTACH":
            return self._attach(flat)
        if head[0] == "COPY":
            return self._copy(flat, now)
        if head[0] == "CREATE":
            return self._create(flat, now)
        if head[0] == "DROP":
            if m := re.match(rf"(?i)DROP (?:TABLE|VIEW)(?: IF EXISTS)? ({_NAME})", flat):
                self.tables.pop(self.view_name(m[1]), None)
                self.spark.catalog.dropTempView(self.view_name(m[1]))
            return None
        if head[0] == "DELETE":
            m = re.match(rf"(?is)DELETE FROM ({_NAME})(?: WHERE (.*))?$", flat)
            n = self.table(m[1]).delete(self._translate(m[2], now) if m[2] else F.lit(True))
            return self.spark.createDataFrame([(n,)], "Count long")
        if head[0] == "INSERT":
            return self._insert(flat, now, batch)
        return self._select(flat, now)

    def _translate(self, sql: str, now: str | None) -> str:
        dialect = self._dialect(now)
        text = dialect.translate(sql)
        for name, form, path, options in dialect.files:
            self.spark.read.format(form).options(**options).load(path).createOrReplaceTempView(name)
        return text

    def _select(self, sql: str, now: str | None) -> DataFrame:
        for m in re.finditer(r"(?i)\b(?:FROM|JOIN) (\w+)\.(\w+)", sql):
            if (options := self.attached.get(m[1].lower())) is not None:
                self._open(m[1], m[2], dict(options))
                sql = sql.replace(f"{m[1]}.{m[2]}", f"{m[1]}__{m[2]} AS {m[2]}" if not re.match(rf"(?i).*{re.escape(m[0])} (AS )?(?!ON\b|WHERE\b|GROUP\b|ORDER\b|LEFT\b|JOIN\b)\w", sql, re.S) else f"{m[1]}__{m[2]}")
        return self.spark.sql(self._translate(sql, now))

    def _open(self, catalog: str, table: str, options: dict[str, str]) -> None:
        form = options.pop("format", "parquet")
        if form == "jdbc":
            made = self.spark.read.format("jdbc").options(dbtable=table, **options).load()
        else:
            made = self.spark.read.format(form).load(f"{options['path']}/{table}.{form}")
        made.createOrReplaceTempView(f"{catalog}__{table}")

    def _set(self, sql: str) -> None:
        m = re.match(r"(?is)SET (?:GLOBAL |SESSION )?(\w+)(?: TIME ZONE)?\s*(?:=|TO| )\s*'?([^']*)'?$", sql)
        name, value = (m[1].lower(), m[2].strip()) if m else ("", "")
        known = {"s3_endpoint": "fs.s3a.endpoint", "s3_access_key_id": "fs.s3a.access.key", "s3_secret_access_key": "fs.s3a.secret.key", "s3_region": "fs.s3a.endpoint.region"}
        hadoop = self.spark._jsc.hadoopConfiguration()
        if name in ("timezone", "time"):
            self.spark.conf.set("spark.sql.session.timeZone", value)
        elif name in known:
            hadoop.set(known[name], value)
        elif name == "s3_url_style":
            hadoop.set("fs.s3a.path.style.access", str(value == "path").lower())
        elif name == "s3_use_ssl":
            hadoop.set("fs.s3a.connection.ssl.enabled", value.lower())
        self.settings[name] = value

    def _attach(self, sql: str) -> None:
        m = re.match(r"(?is)ATTACH (?:IF NOT EXISTS )?'([^']*)'(?: AS (\w+))?(?: \((.*)\))?", sql)
        uri, options = m[1], (m[3] or "").upper()
        name = m[2] or re.sub(r"\W", "", uri.rpartition(":")[2].rpartition("/")[2])
        if name.lower() in self.attached:
            return
        if "POSTGRES" in options:
            made = re.match(r"postgres(?:ql)?://(?:([^:@/]+)(?::([^@/]*))?@)?(.*)", uri)
            login = {"user": made[1], "password": made[2]} if made and made[1] else {}
            self.attach(name, format="jdbc", url=f"jdbc:postgresql://{made[3]}", driver="org.postgresql.Driver", **{k: v for k, v in login.items() if v})
        elif "://" in uri or uri.startswith("/"):
            self.attach(name, path=uri)
        # else a database of our own: its tables are state tables

    def _copy(self, sql: str, now: str | None) -> None:
        m = re.match(r"(?is)COPY (\(.*\)|[\w.]+) TO '([^']+)'(?: \((.*)\))?$", sql)
        if not m:
            raise UnsupportedSQL(sql)
        form = (re.search(r"(?i)FORMAT '?(\w+)", m[3] or "") or [None, m[2].rpartition(".")[2]])[1].lower()
        rows = self._select(m[1][1:-1] if m[1][0] == "(" else f"SELECT * FROM {m[1]}", now)
        rows.coalesce(1).write.format(form).mode("overwrite").options(**({"header": "true"} if form == "csv" else {})).save(m[2].replace("s3://", "s3a://"))

    def _create(self, sql: str, now: str | None) -> None:
        if m := re.match(rf"(?is)CREATE (?:OR REPLACE )?(?:TEMP(?:ORARY)? )?(VIEW|TABLE)(?: IF NOT EXISTS)? ({_NAME}) AS (.*)$", sql):
            rows = self._select(m[3], now)
            if m[1].upper() == "TABLE":  # frozen as it is now
                rows = rows.persist()
                rows.count()
                if before := self.frozen.pop(self.view_name(m[2]), None):
                    before.unpersist()
                self.frozen[self.view_name(m[2])] = rows
            rows.createOrReplaceTempView(self.view_name(m[2]))
            return
        if m := re.match(rf"(?is)CREATE UNIQUE INDEX (?:IF NOT EXISTS )?\w* ?ON ({_NAME}) ?\((.*)\)$", sql):
            self.table(m[1]).keys = [c.strip().strip('"`') for c in m[2].split(",")]
            return
        m = re.match(rf"(?is)CREATE (OR REPLACE )?(?:TEMP(?:ORARY)? )?TABLE( IF NOT EXISTS)? ({_NAME}) ?\((.*)\)$", sql)
        if not m:
            if re.match(r"(?is)CREATE (SCHEMA|DATABASE|SECRET|INDEX)", sql):
                return
            raise UnsupportedSQL(sql)
        name = self.view_name(m[3])
        if name in self.tables and not m[1]:
            if m[2]:
                return
            raise ValueError(f"table {m[3]} exists")
        fields, keys, defaults = [], [], {}
        for part in Dialect()._arguments(tokenize(m[4])):
            text = text_of(spaced(part)).strip()
            if k := re.match(r"(?is)(?:PRIMARY KEY|UNIQUE) ?\((.*)\)$", text):
                keys = [c.strip().strip('"`') for c in k[1].split(",")]
                continue
            column, rest = text.split(None, 1)
            column = column.strip('"`')
            kind = re.split(r"(?i) (?:DEFAULT|PRIMARY KEY|NOT NULL|UNIQUE)\b", rest)[0]
            if d := re.search(r"(?is) DEFAULT (.*?)(?: NOT NULL| PRIMARY KEY|$)", rest):
                defaults[column] = d[1]
            if re.search(r"(?i) (PRIMARY KEY|UNIQUE)", rest):
                keys = [column]
            fields.append(f"`{column}` {column_type(kind)}")
        schema = T._parse_datatype_string(", ".join(fields))
        self.tables[name] = StateTable(self.spark, name, f"{self.root}/{name}", schema, keys, defaults)
        if m[1]:
            self.tables[name].reset()
        self.tables[name].view()

    def _insert(self, sql: str, now: str | None, batch) -> DataFrame:
        m = re.match(rf"(?is)INSERT INTO ({_NAME})(?: ?\(([^()]*)\))?( BY NAME)? (.*)$", sql)
        target, listed, by_name, rest = m[1], m[2], bool(m[3]), m[4].strip()
        conflict = re.search(r"(?is) ON CONFLICT ?(?:\(([^)]*)\))? ?DO (NOTHING|UPDATE SET (.*))$", rest)
        body = rest[: conflict.start()] if conflict else rest
        while body.startswith("(") and body.endswith(")"):
            body = body[1:-1].strip()
        rows = self._select(body, now)
        if listed:
            rows, by_name = rows.toDF(*(c.strip().strip('"`') for c in listed.split(","))), True
        if self.view_name(target) not in self.tables:  # a Spark table
            n = rows.count()
            (rows.write.insertInto(target) if not by_name else rows.select(*self.spark.table(target).columns).write.insertInto(target))
            return self.spark.createDataFrame([(n,)], "Count long")
        table = self.table(target)
        rows = rows.persist()
        try:
            n = rows.count()
            if conflict:
                keys = [c.strip().strip('"`') for c in conflict[1].split(",")] if conflict[1] else table.keys
                sets = {}
                for part in Dialect()._arguments(tokenize(conflict[3] or "")):
                    if solid(part):
                        column, _, value = text_of(part).partition("=")
                        sets[column.strip().strip('"`')] = self._translate(value.strip(), now)
                table.upsert(rows, sets, keys, by_name, batch)
            else:
                table.append(rows, by_name, batch)
        finally:
            rows.unpersist()
        return self.spark.createDataFrame([(n,)], "Count long")
