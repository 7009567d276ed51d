"""Infrastructure files: Dockerfiles and Terraform as numbered lines, YAML kinds as parsed resources."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .lines import exploded, segments

SECRET_KEY = r"(?i)password|secret|api_key|token|private_key"
ADMIN_PORTS = (22, 2375, 2376, 3306, 5432, 6379, 27017)


def dockerfile_findings(files: DataFrame) -> DataFrame:
    """Root user, unpinned base image, secrets in ENV or ARG, of Dockerfiles ``files(path, content)``."""
    d = exploded(files.where(F.col("path").rlike(r"(^|/)Dockerfile[^/]*$")), ["path"], "content")
    d = d.withColumn("op", F.upper(F.regexp_extract("line", r"^\s*([A-Za-z]+)\s", 1))).withColumn("arg", F.regexp_extract("line", r"^\s*[A-Za-z]+\s+(.*)$", 1))
    users = d.groupBy("path").agg(F.max_by(F.when(F.col("op") == "USER", F.trim("arg")), F.when(F.col("op") == "USER", F.col("line_no"))).alias("user"))
    root = users.where("user is null or split(user, ':')[0] in ('root', '0')").select("path", F.lit(1).alias("line_no"), F.lit("IAC-001").alias("rule_id"), F.lit("HIGH").alias("severity"))
    image = F.split_part(F.trim(F.regexp_replace("arg", r"^--platform=\S+\s+", "")), F.lit(" "), F.lit(1))
    stage = d.where("op = 'FROM'").select("path", F.lower(F.regexp_extract("arg", r"(?i)\sas\s+(\S+)", 1)).alias("image")).where("image <> ''").distinct()
    loose = d.where("op = 'FROM'").withColumn("image", image).where(~F.contains("image", F.lit("@")) & (F.endswith("image", F.lit(":latest")) | ~F.element_at(F.split("image", "/"), -1).contains(":")) & (F.col("image") != "scratch"))
    loose = loose.join(stage, (loose.path == stage.path) & (F.lower(loose.image) == stage.image), "left_anti").select("path", "line_no", F.lit("IAC-002").alias("rule_id"), F.lit("MEDIUM").alias("severity"))
    # ENV A=1 B=2 sets several keys, ENV A 1 one
    keys = F.when(F.contains("arg", F.lit("=")), F.regexp_extract_all("arg", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)="), 1)).otherwise(F.slice(F.split("arg", r"\s"), 1, 1))
    secret = d.where(F.col("op").isin("ENV", "ARG") & F.exists(keys, lambda k: k.rlike(SECRET_KEY))).select("path", "line_no", F.lit("IAC-003").alias("rule_id"), F.lit("CRITICAL").alias("severity"))
    return root.unionByName(loose).unionByName(secret)


TERRAFORM = (
    ("IAC-011", "CRITICAL", r"aws_s3_bucket|storage", r"public-read|0\.0\.0\.0/0|publicly_accessible\s*=\s*true"),
    ("IAC-012", "CRITICAL", r"aws_db_instance|rds|database|sql", r"publicly_accessible\s*=\s*true|0\.0\.0\.0/0"),
    ("IAC-013", "HIGH", r".", r"encrypted\s*=\s*false|encryption\s*=\s*false"),
    ("IAC-014", "CRITICAL", r"iam", r"\*"),
)


def terraform_resources(files: DataFrame) -> DataFrame:
    lines = exploded(files.where(F.endswith("path", F.lit(".tf"))), ["path"], "content")
    blocks = segments(lines, ["path"], "line_no", F.col("line").rlike(r'^\s*(resource|data|module|variable|provider|output)\b'))
    return blocks.select("path", "block", F.regexp_extract("header", r'"([^"]+)"', 1).alias("kind"), F.regexp_extract("header", r'"[^"]+"\s+"([^"]+)"', 1).alias("name"), "body").where(F.col("body").rlike(r"^\s*resource\b"))


def terraform_findings(files: DataFrame) -> DataFrame:
    r = terraform_resources(files)
    hits = [F.when(F.col("kind").rlike(kind) & F.col("body").rlike(body), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, kind, body in TERRAFORM]
    return r.withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).select("path", "kind", "name", "hit.*")


def _documents(content: str) -> list:
    """YAML documents, or one JSON document; unreadable files give none. PyYAML reads ``on`` as true."""
    try:
        import yaml

        # templates of charts: lines that only steer go, values in braces become a word
        plain = re.sub(r"\{\{[^{}]*\}\}", "value", re.sub(r"(?m)^\s*\{\{[-#/]?\s*(?:if|else|end|with|range|define|include|template|-)[^\n]*\}\}\s*$", "", content)) if re.search(r"\{\{\s*[-.]|\.Values", content) and "jobs:" not in content else content
    except ImportError:
        try:
            return [json.loads(content)]
        except ValueError:
            return []
    try:
        return [d for d in yaml.safe_load_all(plain) if isinstance(d, dict)]
    except yaml.YAMLError:
        return []


def _ports(text: str) -> range:
    """The ports of one side of a mapping, a number or a range."""
    low, _, high = text.partition("-")
    return range(int(low), int(high or low) + 1) if low.isdigit() and (high.isdigit() or not high) else range(0)


def _compose(doc: dict):
    for name, s in (doc.get("services") or {}).items():
        if not isinstance(s, dict):
            continue
        if s.get("privileged"):
            yield name, "IAC-004", "CRITICAL"
        if s.get("network_mode") == "host":
            yield name, "IAC-005", "HIGH"
        for p in s.get("ports") or ():
            parts = str(p).split("/")[0].split(":")
            host = parts[0] if len(parts) == 3 else ""
            if host in ("", "0.0.0.0", "*") and any(p in ADMIN_PORTS for x in parts[-2:] for p in _ports(x)):
                yield name, "IAC-006", "HIGH"


def _kubernetes(doc: dict):
    kind, name = doc.get("kind"), (doc.get("metadata") or {}).get("name", "")
    if kind in ("Role", "ClusterRole"):
        if any("*" in (r.get("verbs") or ()) and "*" in (r.get("resources") or ()) for r in doc.get("rules") or ()):
            yield name, "IAC-010", "CRITICAL"
    spec = doc.get("spec") or {}
    if kind == "CronJob":
        spec = ((spec.get("jobTemplate") or {}).get("spec")) or {}
    pod = spec if kind == "Pod" else (spec.get("template") or {}).get("spec") if kind in ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "ReplicaSet") else None
    if not isinstance(pod, dict):
        return
    whole = pod.get("securityContext") or {}
    each = [c.get("securityContext") or {} for k in ("initContainers", "containers", "ephemeralContainers") for c in pod.get(k) or ()]
    if any(c.get("privileged") for c in (whole, *each)):
        yield name, "IAC-007", "CRITICAL"
    # a container's own setting stands before the pod's; each container must be safe
    safe = lambda c: bool(c.get("runAsNonRoot", whole.get("runAsNonRoot"))) or (c.get("runAsUser", whole.get("runAsUser")) or 0) > 0
    if not all(map(safe, each or [whole])):
        yield name, "IAC-008", "HIGH"
    if pod.get("hostNetwork"):
        yield name, "IAC-009", "HIGH"


def _workflow(doc: dict):
    on = doc.get("on", doc.get(True)) or {}
    if "pull_request_target" in (on if isinstance(on, (list, dict)) else [on]):
        yield "on", "IAC-016", "HIGH"
    for job, j in (doc.get("jobs") or {}).items():
        for s in (j or {}).get("steps") or ():
            ref = str(s.get("uses") or "")
            tag = ref.partition("@")[2]
            if ref and not ref.startswith("./") and not (len(tag) == 40 and all(c in "0123456789abcdef" for c in tag)):
                yield job, "IAC-015", "MEDIUM"
            run = str(s.get("run") or "")
            if any(x in run for x in ("github.event.issue", "github.event.pull_request", "github.event.head_commit", "github.event.comment")):
                yield job, "IAC-017", "CRITICAL"


def yaml_findings(files: DataFrame) -> DataFrame:
    """Compose, Kubernetes and workflow rules."""

    def own(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                for doc in _documents(content or ""):
                    found = _kubernetes(doc) if "kind" in doc else _workflow(doc) if "jobs" in doc else _compose(doc)
                    rows += [(path, str(n), r, s) for n, r, s in found]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "name", "rule_id", "severity"])

    ship(files.sparkSession)
    return files.where(F.col("path").rlike(r"\.ya?ml$")).select("path", "content").mapInArrow(own, "path string, name string, rule_id string, severity string")


def infra_paths(edges: DataFrame, resources: DataFrame) -> DataFrame:
    """public -> privileged or root -> datastore or IAM, as two joins."""
    r = lambda n, cond: resources.where(cond).select(F.col("id").alias(n))
    e = edges.select("src", "dst").distinct()
    first = e.join(r("src", "public"), "src").join(r("dst", "privileged or runs_as_root"), "dst").select(F.col("src").alias("entry"), F.col("dst").alias("via"))
    return first.join(e.withColumnRenamed("src", "via"), "via").join(r("dst", "kind in ('database', 'storage', 'iam')"), "dst").select("entry", "via", F.col("dst").alias("asset"))


def _resource(doc: dict):
    """(kind, name, public, privileged) of what a YAML document declares."""
    kind, meta = str(doc.get("kind") or ""), doc.get("metadata") or {}
    if "services" in doc and not kind:
        for name, s in (doc["services"] or {}).items():
            if isinstance(s, dict):
                open_ = any((str(p).split(":")[0] if str(p).count(":") == 2 else "") in ("", "0.0.0.0", "*") for p in s.get("ports") or ())
                yield "DOCKER_COMPOSE", str(name), open_, bool(s.get("privileged"))
    elif "jobs" in doc and not kind:
        yield "CICD_WORKFLOW", str(doc.get("name") or "workflow"), False, False
    elif kind:
        public = kind == "Ingress" or kind == "Service" and (doc.get("spec") or {}).get("type") in ("LoadBalancer", "NodePort")
        group = "KUBERNETES_RBAC" if "Role" in kind else "KUBERNETES_SERVICE" if kind == "Service" else "KUBERNETES_INGRESS" if kind == "Ingress" else "KUBERNETES_WORKLOAD"
        yield group, str(meta.get("name") or ""), public, any(r == "IAC-007" for _, r, _ in _kubernetes(doc))


def resources(files: DataFrame) -> DataFrame:
    """path, kind, name, is_public, is_privileged of YAML documents, Dockerfiles and Terraform blocks."""

    def own(batches):
        for b in batches:
            rows = [(path, *r) for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True) for doc in _documents(content or "") for r in _resource(doc)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string()] * 3 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "kind", "name", "is_public", "is_privileged"])

    ship(files.sparkSession)
    schema = "path string, kind string, name string, is_public boolean, is_privileged boolean"
    yaml_rows = files.where(F.col("path").rlike(r"\.ya?ml$")).select("path", "content").mapInArrow(own, schema)
    root = dockerfile_findings(files).where("rule_id = 'IAC-001'").select("path", F.lit(True).alias("_root")).distinct()
    docker = files.where(F.col("path").rlike(r"(^|/)Dockerfile[^/]*$")).select("path").join(root, "path", "left").select("path", F.lit("DOCKERFILE").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(False).alias("is_public"), F.coalesce("_root", F.lit(False)).alias("is_privileged"))
    group = F.when(F.col("kind").rlike("iam"), "CLOUD_IAM").when(F.col("kind").rlike("db_instance|rds|database|sql"), "CLOUD_DATABASE").when(F.col("kind").rlike("s3_bucket|storage"), "CLOUD_STORAGE").otherwise("CLOUD_NETWORK")
    public = F.col("body").rlike(r"public-read|0\.0\.0\.0/0|publicly_accessible\s*=\s*true")
    cloud = terraform_resources(files).select("path", group.alias("kind"), "name", public.alias("is_public"), F.lit(False).alias("is_privileged"))
    return yaml_rows.unionByName(docker).unionByName(cloud)
