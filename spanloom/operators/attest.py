"""Signed attestations: Ed25519 through the JVM that Spark runs in."""

from __future__ import annotations

import base64
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.ids import allocate_ids
from spanloom.functions.lineage import cut
from spanloom.functions.numeric import fixed
from spanloom.operators.report import STATUS, attestation_spans

FAN = 1024  # digests that are hashed into one of the next level


def _pem(kind: str, body: bytes) -> str:
    text = base64.b64encode(body).decode()
    lines = "\n".join(text[i : i + 64] for i in range(0, len(text), 64))
    return f"-----BEGIN {kind} KEY-----\n{lines}\n-----END {kind} KEY-----\n"


def _body(pem: str) -> bytes:
    return base64.b64decode("".join(line for line in pem.splitlines() if not line.startswith("-----")))


class Signer:
    """A key pair kept beside the store: made on first use, the private file readable by its owner only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.private, self.public = Path(folder, "signing_key.pem"), Path(folder, "signing_key.pub.pem")

    def _java(self, data: bytes):
        return bytearray(data)

    def keys(self) -> tuple[str, str]:
        """PEM texts of the private and the public key."""
        if not self.private.exists():
            pair = self.jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
            factory = self.jvm.java.security.KeyFactory.getInstance("Ed25519")
            loader = self.jvm.java.lang.Class
            spec = lambda key, name: bytes(factory.getKeySpec(key, loader.forName(f"java.security.spec.{name}")).getEncoded())
            self.private.parent.mkdir(parents=True, exist_ok=True)
            with os.fdopen(os.open(self.private, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as out:
                out.write(_pem("PRIVATE", spec(pair.getPrivate(), "PKCS8EncodedKeySpec")))
            self.public.write_text(_pem("PUBLIC", spec(pair.getPublic(), "X509EncodedKeySpec")))
        return self.private.read_text(), self.public.read_text()

    def sign(self, base: dict) -> dict:
        """The document with the public key and a signature over its JSON text in insertion order."""
        private, public = self.keys()
        signed = base | {"public_key": base64.b64encode(public.encode()).decode()}
        spec = self.jvm.java.security.spec.PKCS8EncodedKeySpec(self._java(_body(private)))
        engine = self.jvm.java.security.Signature.getInstance("Ed25519")
        engine.initSign(self.jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(spec))
        engine.update(self._java(canonical(signed)))
        return signed | {"signature": base64.b64encode(bytes(engine.sign())).decode()}

    def verify(self, document: dict) -> bool:
        """False for a missing or wrong signature, and for anything malformed."""
        try:
            signature = base64.b64decode(document["signature"])
            public = base64.b64decode(document["public_key"]).decode()
            rest = {k: v for k, v in document.items() if k != "signature"}
            spec = self.jvm.java.security.spec.X509EncodedKeySpec(self._java(_body(public)))
            engine = self.jvm.java.security.Signature.getInstance("Ed25519")
            engine.initVerify(self.jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(spec))
            engine.update(self._java(canonical(rest)))
            return bool(engine.verify(self._java(signature)))
        except Exception:
            return False


def canonical(document: dict) -> bytes:
    return json.dumps(document, ensure_ascii=False, separators=(",", ":")).encode()


def build_attestation(path: str, content_hash: str, results: list[dict], generated_at: str) -> dict:
    """The unsigned document of one artifact's results, members in fixed order."""
    count = lambda status: sum(r["status"] == status for r in results)
    spans = [
        {
            "start_line": r["start_line"], "end_line": r["end_line"], "status": r["status"], "source": r["source_uri"],
            "confidence": fixed(r["confidence"], 4), "method": r["method"],
        }
        for r in sorted(results, key=lambda r: r["start_line"])
    ]
    coverage = {"total": len(results)} | {s: count(s) for s in ("grounded", "uncertain", "ungrounded")}
    return {"version": 1, "path": path, "content_hash": content_hash, "generated_at": generated_at, "coverage": coverage, "spans": spans}


# --- many files under one signature ------------------------------------------------------------


def reports(results: DataFrame, generated_at: str) -> DataFrame:
    """path, report (its JSON text), digest of each file's results."""
    held = attestation_spans(results)
    coverage = F.struct(F.col("spans").alias("total"), *STATUS)
    document = F.struct(F.lit(1).alias("version"), "path", F.lit(generated_at).alias("generated_at"), coverage.alias("coverage"), F.col("details").alias("spans"))
    written = held.select("path", F.to_json(document, {"ignoreNullFields": "false"}).alias("report"))
    return written.withColumn("digest", F.sha2("report", 256))


def root(digests: DataFrame) -> tuple[int, str]:
    """The number of digests (place, digest; places from 0) and the root of the hash tree over them.

    Each level hashes FAN digests, in the order of their places, into one: a few aggregates for any number of files.
    """
    level = cut(digests.select(F.col("place").cast("bigint").alias("place"), "digest"))
    size = many = level.count()
    while many > 1:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda d: d["digest"])  # FAN at most
        level = cut(level.groupBy(F.floor(F.col("place") / FAN).alias("place")).agg(F.sha2(F.array_join(listed, ""), 256).alias("digest")))
        many = level.count()
    top = level.first()
    return size, top["digest"] if top else ""


def attest_all(results: DataFrame, generated_at: str, signer: Signer) -> tuple[DataFrame, dict]:
    """place, path, report, digest of every file, and one signed document that vouches for all of them.

    Reports and the tree over their digests are made where the results are; the driver, which has the key, signs the root alone.
    """
    rows = cut(allocate_ids(reports(results, generated_at), ["path"], 0, "place"))
    size, top = root(rows)
    return rows, signer.sign({"version": 1, "generated_at": generated_at, "reports": size, "root": top})


def verify_all(rows: DataFrame, document: dict, signer: Signer) -> DataFrame:
    """The rows with ``valid``: the signature holds, the tree over their digests has the signed root, and the report has its digest."""
    size, top = root(rows)
    sound = signer.verify(document) and (document.get("reports"), document.get("root")) == (size, top)
    return rows.withColumn("valid", F.lit(sound) & F.coalesce(F.sha2("report", 256) == F.col("digest"), F.lit(False)))


def write_attestation(document: dict, path: str) -> None:
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False) + "\n")


def read_attestation(path: str) -> dict:
    return json.loads(Path(path).read_text())
