"""Tables that are changed by patches: each patch is checked against the revision that it was made for, and either fails with all that
is wrong with it, or makes a new revision beside the old ones.

A revision is a folder of rows and an entry of a log (a row: number, digest of its rows, the patch's idempotency key, its producer).
The entry is written last and never over another, so that of two patches for one revision one fails; rows without an entry are no
revision. The digest is of the rows as a set: their number and sums of their hashes, which are partial sums of tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import exists

ROWS = "id string, value string, assurance string, state string, supersedes string"
PATCH = "op string, id string, value string, assurance string, supersedes string"
#: Assurances that people alone may give or take away, and who is no person.
CONFIRMED = ("constraint_validated", "human_approved")
MODELS = ("reader", "tracer", "visual_verifier")
#: Ids that an error names.
NAMED = 20


class PatchError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Revisions:
    spark: SparkSession
    folder: str

    def _log(self) -> DataFrame:
        return self.spark.read.schema("revision long, digest string, key string, producer string").option("recursiveFileLookup", "true").parquet(f"{self.folder}/log")

    def head(self) -> tuple[int, str]:
        """Number and digest of the last revision."""
        r = self._log().agg(F.max(F.struct("revision", "digest")).alias("last")).first().last
        return r.revision, r.digest

    def read(self, revision: int | None = None) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.folder}/rows/{self.head()[0] if revision is None else revision}")

    def _write(self, rows: DataFrame, revision: int, key: str, producer: str) -> tuple[int, str]:
        if revision > 1 and exists(self.spark, f"{self.folder}/log/{revision}/_SUCCESS"):
            raise PatchError(["stale_base_revision"])
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/{revision}")
        own = digest_of(self.spark.read.schema(ROWS).parquet(f"{self.folder}/rows/{revision}"))
        entry = self.spark.createDataFrame([(revision, own, key, producer)], "revision long, digest string, key string, producer string")
        entry.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/log/{revision}")
        return revision, own

    def create(self, rows: DataFrame, producer: str = "system") -> tuple[int, str]:
        """The first revision, of rows id, value, assurance."""
        return self._write(rows.select("id", "value", "assurance", F.lit("active").alias("state"), F.lit(None).cast("string").alias("supersedes")), 1, "", producer)

    def apply(self, patch: DataFrame, base: tuple[int, str], key: str, producer: str) -> tuple[int, str]:
        """Number and digest of the revision that the patch makes. patch: op (add, supersede or retract), id, and for what is added
        value, assurance and supersedes (the id that it stands for)."""
        current, errors = self.read(), []
        last = self.head()
        if tuple(base) != last:
            errors.append("stale_base_revision")
        if self._log().where(F.col("key") == key).head(1):
            errors.append("duplicate_idempotency_key")
        added, touched = patch.where("op = 'add'"), patch.where("op IN ('supersede', 'retract')").select("op", "id")
        if producer in MODELS and added.where(F.col("assurance").isin(*CONFIRMED)).head(1):
            errors.append("producer_cannot_validate_or_approve")

        def named(what: str, ids: DataFrame) -> None:
            found = [r.id for r in ids.select("id").distinct().orderBy("id").limit(NAMED + 1).collect()]
            if found:
                errors.append(f"{what}:{','.join(found[:NAMED])}{',...' if len(found) > NAMED else ''}")

        named("unknown_assertions", touched.join(current, "id", "left_anti"))
        if producer != "human":  # what is confirmed may be replaced by the same value alone
            heirs = added.select(F.col("supersedes").alias("id"), F.col("value").alias("new_value"))
            confirmed = current.where(F.col("assurance").isin(*CONFIRMED)).select("id", F.col("value").alias("old_value"))
            kept = touched.where("op = 'supersede'").join(confirmed, "id").join(heirs, "id").where(F.col("new_value").eqNullSafe(F.col("old_value"))).select("id")
            kept = kept.join(touched.where("op = 'retract'"), "id", "left_anti")
            named("confirmed_assertions_require_human", touched.join(confirmed, "id", "left_semi").join(kept, "id", "left_anti"))
        without = touched.where("op = 'supersede'").join(added.select(F.col("supersedes").alias("id")), "id", "left_anti")
        if without.head(1):
            errors.append("supersede_requires_replacement_assertion")
        every = current.select("id").unionAll(added.select("id"))
        named("graph_integrity", every.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").select(F.coalesce("id", F.lit("null")).alias("id")))
        if patch.where("op IS NULL OR op NOT IN ('add', 'supersede', 'retract')").head(1):
            errors.append("unknown_operation")
        if errors:
            raise PatchError(errors)
        ends = touched.groupBy("id").agg(F.when(F.bool_or(F.col("op") == "supersede"), "superseded").otherwise("retracted").alias("end"))
        old = current.join(ends, "id", "left").select("id", "value", "assurance", F.coalesce("end", "state").alias("state"), "supersedes")
        new = added.select("id", "value", "assurance", F.lit("active").alias("state"), "supersedes")
        return self._write(old.unionByName(new), last[0] + 1, key, producer)


def digest_of(rows: DataFrame) -> str:
    """A digest of rows as a set that counts repeated ones."""
    hashed = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substr(hashed, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("decimal(38,0)")
    r = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(8))).first()
    return hashlib.sha256(",".join(str(x) for x in r).encode()).hexdigest()
