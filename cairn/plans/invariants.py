"""V2: the invariants of a store as a rule table, over its files and the keys of its computers.

Each relation is made once, with a column for each rule; ``check_rules`` counts all rules of a relation in one pass.
Every object, pack and record is checked, no sample of them. A file that must be there and is not is a row without
content, and so breaks the rules about what is in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import envelope
from cairn.plans.validate import Rule, check_rules
from cairn.sources import keyset, store
from cairn.sources.store import UUID

# The keys that the documents of the format must have, and the kinds of their values.
CONFIG = {
    "blobIdentifierType": "int", "maxPackedItemLength": "int", "backupName": "str", "isWORM": "bool", "containsGlacierArchives": "bool", "additionalUnpackedBlobDirs": "list",
    "chunkerVersion": "int", "computerName": "str", "computerSerial": "str", "blobStorageClass": "str", "isEncrypted": "bool",
}
PLAN = {
    "active": "bool", "backupFolderPlansByUUID": "dict", "isEncrypted": "bool", "name": "str", "planUUID": "str", "scheduleJSON": "dict", "transferRateJSON": "dict", "emailReportJSON": "dict", "version": "int", "useBuzhash": "bool",
}
FOLDER_PLAN = ("backupFolderUUID", "localPath", "name", "localMountPoint", "skipDuringBackup")
FOLDER_INDEX = ("standardObjectDirs", "standardIAObjectDirs", "onezoneIAObjectDirs", "s3GlacierObjectDirs", "s3GlacierIRObjectDirs", "s3DeepArchiveObjectDirs")
FOLDER = ("localPath", "localMountPoint", "name", "uuid", "migratedFromArq60", "migratedFromArq5", "storageClass", "diskIdentifier")
RECORD = ("node", "creationDate", "arqVersion", "computerOSType", "backupFolderUUID", "backupPlanUUID", "backupPlanJSON", "version", "isComplete")
# The keys of the parts of a plan that have several forms, by what tells the form.
SCHEDULES = {
    "Daily": ("backUpAndValidate", "daysOfWeek", "pauseDuringWindow", "startWhenVolumeIsConnected", "timeOfDay", "type"),
    "Hourly": ("daysOfWeek", "everyHours", "minutesAfterHour", "pauseDuringWindow", "pauseFrom", "pauseTo", "startWhenVolumeIsConnected", "type"),
}
TRANSFERS = {
    "Always": ("daysOfWeek", "enabled", "endTimeOfDay", "scheduleType", "startTimeOfDay"),
    "Scheduled": ("daysOfWeek", "enabled", "endTimeOfDay", "maxKBPS", "scheduleType", "startTimeOfDay"),
}
REPORTS = {
    "not configured": ("authenticationType", "connectionSecurity", "port", "reportHELOUseIP", "type", "when"),
    "mail": ("authenticationType", "connectionSecurity", "port", "reportHELOUseIP", "type", "when", "fromAddress", "hostname", "startTLS", "subject", "toAddress", "username"),
}
# Versions and codes that are known.
CHUNKERS, ID_TYPES, RECORD_VERSIONS = (1, 2, 3), (1, 2), (100, 101, 200)
_KINDS = {"int": "BIGINT", "str": "STRING", "bool": "BOOLEAN", "list": "ARRAY", "dict": "OBJECT"}


def _kind(document: Column, key: str) -> Column:
    """What kind of value a JSON text has at a key, null if it has none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant"))


def _is(document: Column, key: str, kind: str) -> Column:
    return F.startswith(_kind(document, key), F.lit(_KINDS[kind]))


def _form(document: Column, part: str, forms: dict[str, tuple], tells: str | None) -> Column:
    """A part's keys are exactly those of its form; a part that is no object is another rule's matter."""
    text = F.get_json_object(document, f"$.{part}")
    have = F.array_sort(F.json_object_keys(text))
    ok = F.lit(False)
    for name, keys in forms.items():
        same = have == F.array(*map(F.lit, sorted(keys)))
        ok = ok | (same & (F.get_json_object(text, f"$.{tells}") == name) if tells else same)
    return F.when(_is(document, part, "dict"), ok).otherwise(F.lit(True))


def _named(files: DataFrame, tail: str) -> DataFrame:
    """(cu, content) of the file of each computer whose path ends with ``cu/tail``."""
    at = rf"/({UUID})/{tail}$"
    return files.where(F.col("path").rlike(at)).select(F.regexp_extract("path", at, 1).alias("cu"), "content")


def open_keysets(spark: SparkSession, files: DataFrame, password: str) -> tuple[dict[str, keyset.Keyset], dict[str, str]]:
    """The keysets that open, and for the others the rule they break. A keyset file is some hundred bytes, one a computer."""
    good, bad = {}, {}
    for r in _named(files, "encryptedkeyset[^/]*").toLocalIterator():
        try:
            good[r.cu] = keyset.open_keyset(spark, bytes(r.content), password)
        except keyset.KeysetError as e:
            bad[r.cu] = e.rule
    return good, bad


def relations(spark: SparkSession, files: DataFrame, password: str) -> dict[str, DataFrame]:
    """The relations that the rules are about, from a listing (path, length, content)."""
    good, bad = open_keysets(spark, files, password)
    rings = keyset.keys(spark, good)
    level = {"C1": 1, "C2": 2, "C3": 3, "C4": 4}
    broken = spark.createDataFrame([(cu, level[r]) for cu, r in bad.items()] + [(cu, 9) for cu in good], "cu string, broken int")
    cu = F.regexp_extract("path", f"/({UUID})/", 1)
    computers = files.select(cu.alias("cu")).where("cu <> ''").distinct()
    whole = computers.join(broken, "cu", "left")

    def document(tail: str) -> DataFrame:
        return computers.join(keyset.sidecars(_named(files, tail), rings).select("cu", "document"), "cu", "left")

    at_folder = rf"/({UUID})/backupfolders/({UUID})/"
    folder = files.select(F.regexp_extract("path", at_folder, 1).alias("cu"), F.regexp_extract("path", at_folder, 2).alias("folder")).where("folder <> ''").distinct()
    own = rf"{at_folder}backupfolder\.json$"
    configs = files.where(F.col("path").rlike(own)).select(F.regexp_extract("path", own, 1).alias("cu"), F.regexp_extract("path", own, 2).alias("folder"), "content")
    folders = folder.join(keyset.sidecars(configs, rings).select("cu", "folder", "document"), ["cu", "folder"], "left")

    at_record = rf"/({UUID})/backupfolders/{UUID}/backuprecords/[0-9]{{5}}/([^/]*)\.backuprecord$"
    rec = files.where(F.col("path").rlike(at_record)).select("path", F.regexp_extract("path", at_record, 1).alias("cu"), F.regexp_extract("path", at_record, 2).alias("stem"), "content").join(rings, "cu", "left")
    rec = rec.withColumn("opened", F.when(keyset.mac_ok(F.col("content"), F.col("inner_pad"), F.col("outer_pad")), keyset.opened(F.col("content"), F.col("encryption_key"))))
    rec = rec.withColumn("magic", keyset.has_magic(F.col("content"))).withColumn("plain", envelope.decompressed()("opened", F.lit(envelope.LZ4))["data"])
    records = store.parsed_records(rec.select("cu", "path", "stem", "magic", "plain"), "plain")

    at_object = rf"/({UUID})/standardobjects/([^/]*)/([^/]*)$"
    obj = files.where(F.col("path").rlike(at_object)).select(*[F.regexp_extract("path", at_object, i).alias(n) for i, n in ((1, "cu"), (2, "shard"), (3, "name"))], "content").join(rings, "cu", "left")
    obj = obj.withColumn("shaped", F.col("shard").rlike("^[0-9A-Fa-f]{2}$") & F.col("name").rlike(f"^{store.OBJECT}$"))
    obj = obj.withColumn("verified", keyset.mac_ok(F.col("content"), F.col("inner_pad"), F.col("outer_pad")))
    obj = obj.withColumn("opened", F.when(F.col("verified"), keyset.opened(F.col("content"), F.col("encryption_key"))))
    obj = obj.withColumn("plain", envelope.decompressed()("opened", F.lit(envelope.LZ4))["data"])
    objects = obj.select("cu", "shard", "name", "shaped", "verified", "plain", F.sha2(F.concat("salt", "plain"), 256).alias("id"))

    at_pack = rf"/({UUID})/(?:treepacks|blobpacks|largeblobpacks)/[^/]{{2}}/([^/]*)$"
    packs = files.where(F.col("path").rlike(at_pack)).select(F.regexp_extract("path", at_pack, 2).alias("name"), keyset.has_magic(F.col("content")).alias("magic"))
    return {
        "root": computers.agg(F.count(F.lit(1)).alias("computers")), "computers": whole, "folder counts": computers.join(folder.groupBy("cu").agg(F.count(F.lit(1)).alias("folders")), "cu", "left"),
        "configs": document("backupconfig\\.json"), "plans": document("backupplan\\.json"), "folder indexes": document("backupfolders\\.json"), "folders": folders, "records": records, "objects": objects, "packs": packs,
    }


def rules() -> list[Rule]:
    """The invariants, by their ids."""
    d, broken = F.col("document"), F.coalesce(F.col("broken"), F.lit(0))
    out = [
        Rule("L1", "a computer at the top", "root", F.col("computers") > 0), Rule("L2", "keyset present", "computers", F.col("broken").isNotNull()),
        *[Rule(f"C{i}", name, "computers", broken > i) for i, name in ((1, "keyset magic"), (2, "keyset header and whole blocks"), (3, "keyset opens under the password"), (4, "keyset version and key lengths"))],
        Rule("L3", "config is a document", "configs", d.isNotNull()), *[Rule("L3", f"config {k} is {t}", "configs", _is(d, k, t)) for k, t in CONFIG.items()],
        Rule("SV1", "chunker version known", "configs", F.get_json_object(d, "$.chunkerVersion").isin(*map(str, CHUNKERS))), Rule("SV2", "identifier type known", "configs", F.get_json_object(d, "$.blobIdentifierType").isin(*map(str, ID_TYPES))),
        Rule("L4", "plan is a document", "plans", d.isNotNull()), *[Rule("L4", f"plan {k} is {t}", "plans", _is(d, k, t)) for k, t in PLAN.items()],
    ]
    # The folder plans of a plan: each has its keys, not the first one alone.
    each = F.map_values(F.from_json(F.get_json_object(d, "$.backupFolderPlansByUUID"), "map<string,string>"))
    have = lambda k: F.coalesce(F.forall(each, lambda p: F.array_contains(F.json_object_keys(p), k)), F.lit(True))
    out += [Rule("L4", f"folder plan {k}", "plans", F.when(d.isNotNull(), have(k))) for k in FOLDER_PLAN]
    for part, forms, tells in (("scheduleJSON", SCHEDULES, "type"), ("transferRateJSON", TRANSFERS, "scheduleType"), ("emailReportJSON", REPORTS, None)):
        out.append(Rule("L4", f"form of {part}", "plans", F.when(d.isNotNull(), _form(d, part, forms, tells))))
    record = F.col("record")
    version = F.get_json_object(record, "$.version")
    return out + [
        Rule("L5", "folder index is a document", "folder indexes", d.isNotNull()), *[Rule("L5", f"folder index {k} is list", "folder indexes", _is(d, k, "list")) for k in FOLDER_INDEX],
        Rule("L6", "a folder at least", "folder counts", F.col("folders") > 0),
        Rule("L7", "folder config is a document", "folders", d.isNotNull()), *[Rule("L7", f"folder config {k}", "folders", _kind(d, k).isNotNull()) for k in FOLDER],
        Rule("L8", "record name is digits", "records", F.col("stem").rlike("^[0-9]+$")), Rule("B1", "record magic", "records", F.col("magic")), Rule("B2", "record opens", "records", record.isNotNull()),
        *[Rule("B2", f"record {k}", "records", _kind(record, k).isNotNull()) for k in RECORD],
        Rule("B3", "tree node has a place", "records", F.when(record.isNotNull(), ~F.coalesce(F.get_json_object(record, "$.node.isTree") == "true", F.lit(False)) | F.coalesce(_is(record, "node.treeBlobLoc", "dict"), F.lit(False)))),
        Rule("SV3", "record version known", "records", version.isin(*map(str, RECORD_VERSIONS))),
        Rule("S1", "shard names are two digits", "objects", F.col("shard").rlike("^[0-9A-Fa-f]{2}$")), Rule("ID1", "object names are 62 digits", "objects", F.col("name").rlike(f"^{store.OBJECT}$")),
        Rule("A1", "objects verify", "objects", ~F.col("shaped") | (F.col("verified") & F.col("plain").isNotNull())), Rule("ID2", "identifier is that of the content", "objects", ~F.col("shaped") | F.col("plain").isNull() | (F.col("id") == F.lower(F.concat("shard", "name")))),
        Rule("P1", "pack names", "packs", F.col("name").rlike(rf"^{UUID}\.pack$")), Rule("P2", "packs begin with the magic", "packs", F.col("magic")),
    ]


def check_store(spark: SparkSession, files: DataFrame, password: str) -> DataFrame:
    """(id, name, rows, violations, passed) of every invariant. Rules about no rows pass; without keys the rules
    about what is inside envelopes fail."""
    return check_rules(relations(spark, files, password), rules())
