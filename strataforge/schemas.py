"""Table schemas, vocabularies and patterns."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed vocabularies and patterns of the tables.
TRAINED = ("healthy", "rust", "anthracnose")
UNKNOWN = ("unknown_als", "unknown_wm")
UNLABELLED = "none"
CLASSES = (*TRAINED, *UNKNOWN, UNLABELLED)
SPLITS = ("train", "val", "test")
HOLDOUT = "holdout_unknown"
TEST_ONLY = "test_only"
UNBLOCKED = "unblocked:random_by_phash_group"
TARGETS = {"train": 0.70, "val": 0.10, "test": 0.20}
LICENCES = ("CC-BY-4.0", "CC0-1.0", "MIT", "unknown")
FORMATS = ("jpeg", "png")
BLOCK_KEYS = ("district", "subcounty", "date", "region", "session", "variety", "plant_age")
PURPOSES = ("train", "select", "evaluate", "serve", "extract")
RESTRICTED_SPLITS = ("test", HOLDOUT)
RESTRICTED_READERS = ("evaluate", "serve", "extract")
NUMBERS = ("N1", "N2", "N3", "N4", "N5", "N6", "N7")
SCORES = ("conf", "knn", "maha", "energy")
BATCHES = ("b1", "b32", "cached_b1", "cached_b32")
STEPS = ("env", "extract", "train_head", "fit_abstain", "eval", "probe", "bench")
SEEDS = (0, 1, 2, 3, 4)
KEY_FIELDS = ("backbone_id", "weights_sha256", "resolution", "preprocess_string", "compute_dtype")
RUN_KEYS = ("backbone_id", "res", "tokens", "head", "seed", "head_config_sha256")
TOKEN_TYPES, STORAGE_TYPE = ("cls", "meanpatch"), "float16"
T_975_4 = 2.776445
IDENTITY = ("run_id", "number", "metric", "test_manifest_sha256", "test_split", "coverage")
PER_SEED = ("ts", "value", "ci_low", "ci_high", "seed", "run_id", "quotable", "notes")
RULE = rf"^(?:blocked:(?:{'|'.join(BLOCK_KEYS)})|unblocked:random_by_phash_group|test_only|holdout_unknown)$"
FOLD_RULE = r"^unblocked:[1-9][0-9]*fold_by_phash_group$"
HEX64, HEX16, STAMP = r"^[0-9a-f]{64}$", r"^[0-9a-f]{16}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"

_s, _l, _d, _b = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


# The fields of the tables, in order.
BOX = _fields(x=_l, y=_l, w=_l, h=_l, class_raw=_s)
GROUP_KEYS = _fields(district=_s, subcounty=_s, date=_s, region=_s, session=_s, variety=_s, plant_age=_l, phash_group=_s)
MANIFEST = _fields(
    manifest_version=_s, image_id=_s, dataset=_s, source_record=_s, source_version=_s, path=_s, dup_paths=T.ArrayType(_s), sha256=_s, phash=_s, width=_l, height=_l,
    format=_s, class_raw=_s, class_km2=_s, boxes=T.ArrayType(BOX), group_keys=GROUP_KEYS, split_group=_s, split=_s, split_rule=_s, licence=_s, attribution=_s, notes=_s,
)
CROPS = T.StructType([*MANIFEST.fields, T.StructField("parent_image_id", _s), T.StructField("box_index", _l), T.StructField("crop", _fields(x=_l, y=_l, w=_l, h=_l, frame=_s))])
RESULTS = _fields(
    ts=_s, number=_s, metric=_s, value=_d, ci_low=_d, ci_high=_d, n=_l, backbone_id=_s, res=_l, token_type=_s, head=_s, seed=_l, train_manifest=_s, train_manifest_sha256=_s,
    train_split=_s, test_manifest=_s, test_manifest_sha256=_s, test_split=_s, split_rule=_s, coverage=_d, classes=T.ArrayType(_s), run_id=_s, model_version=_s, cache_key=_s,
    quotable=_b, superseded=_s, notes=_s,
)
LEDGER = _fields(ts=_s, step=_s, run_id=_s, device=_s, wallclock_s=_d, n_items=_l, config_sha256=_s, git_sha=_s, host=_s, notes=_s)
REQUESTS = _fields(
    ts=_s, request_id=_s, frame_uid=_s, frame_sha256=_s, uri=_s, site_id=_s, plot_id=_s, zone_id=_s, timestamp_utc=_s, platform=_s, bbch=_l, bbch_null_reason=_s, model_version=_s,
    run_id=_s, coverage=_d, decision=_s, abstain_reason=_s, top1=_s, scores=T.MapType(_s, _d),
    uncertainty=_fields(max_prob=_d, entropy=_d, ood_knn=_d, ood_knn_threshold=_d, ood_maha=_d), features=_s, status=_l, timing_ms=T.MapType(_s, _d),
    errors=T.ArrayType(_fields(path=_s, message=_s)), warnings=T.ArrayType(_s),
)
FROZEN = _fields(manifest=_s, sha256=_s, frozen_at=_s, git_sha=_s)
FEATURES = _fields(backbone=_s, res=_l, cache_key=_s, manifest=_s, image_id=_s, sha256=_s, cls=T.ArrayType(T.FloatType()), meanpatch=T.ArrayType(T.FloatType()))
