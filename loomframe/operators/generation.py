"""Corpora from templates: pools by rule, draws with replacement, quotas without."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.text import fill, unit_hash
from loomframe.operators.sampling import order_key, quota_plan, quota_sample
from loomframe.sources import files

#: Shares of a container corpus by category (fixed values).
CONTAINER_SHARES = (
    ("run", 0.30), ("build", 0.15), ("ps_images", 0.12), ("exec", 0.10),
    ("compose", 0.15), ("network", 0.08), ("volume", 0.06), ("system", 0.04),
)
#: Shares of an environment tool's corpus by command (fixed values).
TOOL_SHARES = (("register", 0.25), ("ls", 0.20), ("scan", 0.10), ("current", 0.15), ("cleanup", 0.15), ("shell-hook", 0.05), ("stats", 0.10))
#: Range of the shift of a confidence (fixed values).
JITTER = (-0.03, 0.02)
#: Names that one task crosses with the patterns, and texts that one task tells apart.
NAMES_A_TASK, TEXTS_A_TASK = 4096, 1 << 18


#: Ways to ask for something; the pools of a container corpus cross them with the rules below.
ASK = ("{x}", "please {x}", "i want to {x}", "how do i {x}", "can you {x}", "{x} now")
IMAGES = (("a web server", "nginx"), ("a database", "postgres"), ("a cache", "redis"), ("a queue", "rabbitmq"), ("a search engine", "opensearch"), ("a shell", "alpine"), ("a proxy", "haproxy"), ("a wiki", "dokuwiki"), ("a document store", "mongo"))
PORTS = (("nginx", 80, 8080), ("nginx", 443, 8443), ("postgres", 5432, 5432), ("redis", 6379, 6379), ("rabbitmq", 5672, 5672), ("opensearch", 9200, 9200), ("haproxy", 80, 80), ("mongo", 27017, 27017))
SETTINGS = (("postgres", "POSTGRES_PASSWORD=example"), ("rabbitmq", "RABBITMQ_DEFAULT_USER=guest"), ("opensearch", "discovery.type=single-node"), ("mongo", "MONGO_INITDB_DATABASE=app"), ("nginx", "NGINX_HOST=localhost"))
NAMES = ("api", "worker", "site", "store", "jobs", "mail")
TAGS = ("app", "app:dev", "app:1.0", "team/app", "site:test", "worker:nightly")
COMMANDS = ("ls /", "env", "sh", "cat /etc/hosts", "ps aux", "df -h", "date", "whoami", "top")


def container_rules(names: tuple[str, ...] = NAMES) -> list[tuple[str, str, str]]:
    """(kind, instruction, command) of all pools of a container corpus, by crossing the tables above with names."""
    out: list[tuple[str, str, str]] = []

    def asked(kind: str, what: str, command: str, ways: int) -> None:
        out.extend((kind, w.format(x=what), f"docker {command}") for w in ASK[:ways])

    for said, image in IMAGES:
        asked("run", f"start {said}", f"run {image}", 4)
        asked("run", f"start {said} in the background", f"run -d {image}", 4)
        asked("run", f"start {said} and remove it afterwards", f"run --rm {image}", 4)
    for image, inner, outer in PORTS:
        asked("run", f"run {image} with port {inner} on {outer}", f"run -d -p {outer}:{inner} {image}", 4)
    for image, setting in SETTINGS:
        asked("run", f"run {image} with {setting}", f"run -e {setting} {image}", 4)
    for name, (_, image) in zip(names, IMAGES, strict=False):
        asked("run", f"run {image} under the name {name}", f"run --name {name} {image}", 5)
        asked("run", f"run {image} with the folder {name} mounted", f"run -v ./{name}:/data {image}", 4)
    for tag in TAGS:
        asked("build", f"build an image called {tag}", f"build -t {tag} .", 6)
        asked("build", f"build {tag} without the cache", f"build --no-cache -t {tag} .", 5)
    for name in names:
        asked("build", f"build from the file Dockerfile.{name}", f"build -f Dockerfile.{name} .", 4)
    asked("build", "build up to the stage test", "build --target test .", 4)
    asked("build", "build with the newest base image", "build --pull .", 3)
    for what, command in (("list containers", "ps"), ("list all containers", "ps -a"), ("show the last container", "ps -l"), ("show container sizes", "ps -s"), ("show container ids only", "ps -q"), ("list images", "images"), ("list all images", "images -a"), ("show image ids only", "images -q"), ("list dangling images", "images -f dangling=true"), ("show image digests", "images --digests"), ("list stopped containers", "ps -f status=exited")):
        asked("ps_images", what, command, 6)
    for command in COMMANDS:
        for name in names:
            asked("exec", f"run {command} in {name}", f"exec {name} {command}", 1)
    for name in names:
        for what, command in (("start", "up -d"), ("restart", "restart"), ("stop", "stop"), ("show the logs of", "logs"), ("build", "build"), ("pull", "pull")):
            asked("compose", f"{what} the service {name}", f"compose {command} {name}", 2)
    asked("compose", "stop all services", "compose down", 4)
    for name in names:
        for what, command in (("create the network {n}", "network create {n}"), ("remove the network {n}", "network rm {n}"), ("inspect the network {n}", "network inspect {n}")):
            asked("network", what.format(n=name), command.format(n=name), 2)
    for name, other in zip(names, names[1:], strict=False):
        asked("network", f"connect {name} to the network {other}", f"network connect {other} {name}", 2)
        asked("network", f"disconnect {name} from the network {other}", f"network disconnect {other} {name}", 2)
    asked("network", "list networks", "network ls", 6)
    for name in names:
        for what, command in (("create", "create"), ("remove", "rm")):
            asked("volume", f"{what} the volume {name}", f"volume {command} {name}", 2)
        asked("volume", f"inspect the volume {name}", f"volume inspect {name}", 1)
    asked("volume", "list volumes", "volume ls", 4)
    asked("volume", "remove unused volumes", "volume prune", 3)
    for what, command in (("show disk usage", "system df"), ("show system information", "info"), ("show the version", "version"), ("remove unused data", "system prune"), ("remove all unused data", "system prune -a"), ("watch events", "events"), ("stop api", "stop api"), ("remove api", "rm api"), ("show resource use", "stats")):
        asked("system", what, command, 3)
    return out


def container_patterns() -> list[tuple[str, str, str, bool]]:
    """(kind, instruction, command, named) of the pools: rules of one object with {name} for it, and those of none."""
    fixed = container_rules(())
    mark = "\0"
    return [(*r, False) for r in fixed] + [(k, *(x.replace(mark, "{name}") for x in r), True) for k, *r in container_rules((mark,)) if mark in r[1]]


#: The tool's commands: ways to say each, and its forms (what is said of the option, the option, what it explains).
TOOL_FORMS = {
    "register": (("register {x}", "add {x} to the list", "keep track of {x}"), (("this environment", "", "the current folder's environment"), ("the environment in {path}", " {path}", "the environment in {path}"), ("this environment as {name}", " --name {name}", "the environment as {name}"), ("this environment for {project}", " --project {project}", "the environment with its project {project}"), ("{path} as {name}", " {path} --name {name}", "the environment in {path} as {name}"))),
    "ls": (("list environments{x}", "show my environments{x}", "which environments are there{x}", "print all environments{x}"), (("", "", "all environments"), (" by {key}", " --sort {key}", "environments by {key}"), (" as {form}", " --format {form}", "environments as {form}"), (" by {key} as {form}", " --sort {key} --format {form}", "environments by {key} as {form}"))),
    "scan": (("scan{x} for environments", "search{x} for environments", "look{x} for environments"), (("", "", "the current folder"), (" the home folder", " --home", "the home folder"), (" {path}", " --path {path}", "{path}"), (" {depth} levels deep", " --depth {depth}", "the current folder, {depth} levels deep"))),
    "current": (("which environment is active{x}", "show the active environment{x}", "what am i using{x}", "print the current environment{x}"), (("", "", "the active environment"), (" now", "", "the active environment"))),
    "cleanup": (("remove environments{x}", "clean up environments{x}"), (("", "", "old environments"), (" unused for {days} days", " --days {days}", "environments unused for {days} days"), (" but only show which", " --dry-run", "what would be removed"), (" without asking", " --yes", "old environments without asking"), (" unused for {days} days without asking", " --days {days} --yes", "environments unused for {days} days without asking"))),
    "shell-hook": (("install the hook{x}", "set up the hook{x}"), ((" for {shell}", " --shell {shell}", "the hook for {shell}"), ("", "", "the hook"), (" for the login shell", " --login", "the hook for the login shell"))),
    "stats": (("show usage{x}", "how much space is used{x}", "print statistics{x}", "sum up disk use{x}"), (("", "", "use of space"), (" by project", " --by project", "use of space by project"))),
}
#: Further templates of one form.
TOOL_EXTRA = (("scan", "look in {path} {depth} levels deep", " --path {path} --depth {depth}", "{path}, {depth} levels deep"), ("cleanup", "what would a cleanup remove", " --dry-run", "what would be removed"), ("shell-hook", "print the hook", " --print", "the hook"))
#: What may stand in a slot; those of "key" and "form" are options of the tool (fixed values).
SLOTS = {
    "path": (".venv", "./env", "../shared/env", "/srv/envs/a", "~/envs/test"), "name": ("site", "api", "batch", "lab"), "project": ("./site", "../api", "~/code/batch"), "key": ("name", "recent", "size", "project"),
    "form": ("table", "json", "simple"), "depth": ("1", "2", "3", "5"), "days": ("30", "60", "90", "180"), "shell": ("bash", "zsh", "fish"),
}


def tool_templates() -> list[tuple[str, int, str, str, float, str]]:
    """(kind, t, pattern, command, base confidence, explanation) of the tool's templates; t counts from 0 in a kind."""
    out: list[tuple[str, int, str, str, float, str]] = []
    for kind, (ways, forms) in TOOL_FORMS.items():
        # the plainer the wording, the surer the command
        rows = [(way.format(x="\0").replace("\0", said), option, round(0.95 - 0.02 * k, 2), told) for said, option, told in forms for k, way in enumerate(ways)]
        rows += [(said, option, 0.9, told) for other, said, option, told in TOOL_EXTRA if other == kind]
        out.extend((kind, t, said, f"tool {kind}{option}", base, f"Handles {told}") for t, (said, option, base, told) in enumerate(rows))
    return out


def pool(spark: SparkSession) -> DataFrame:
    """``kind``, ``k``, ``instruction``, ``command``: the pairs of all pools, numbered in their kind."""
    count: dict[str, int] = {}
    rows = []
    for kind, said, command in container_rules():
        rows.append((kind, count.setdefault(kind, 0), said, command))
        count[kind] += 1
    return spark.createDataFrame(rows, "kind string, k int, instruction string, command string")


def named_pool(names: DataFrame, weight: str | None = None) -> DataFrame:
    """``kind``, ``instruction``, ``command``: the patterns without a name once, the others with each ``name`` of a table.

    ``weight``: a column of the names that their rows keep; 1 for patterns without a name. A task crosses
    about NAMES_A_TASK names, whatever files they come from.
    """
    patterns = names.sparkSession.createDataFrame(container_patterns(), "kind string, instruction string, command string, named boolean")
    filled = [fill(F.col(c), name=F.col("name")).alias(c) for c in ("instruction", "command")]
    kept = [weight] if weight else []
    spread = names.select("name", *kept).repartition(max(1, -(-names.count() // NAMES_A_TASK)))
    # the patterns are a table of fixed size
    crossed = spread.crossJoin(F.broadcast(patterns.filter("named"))).select("kind", *filled, *kept)
    return patterns.filter("not named").select("kind", "instruction", "command", *[F.lit(1).cast("long").alias(w) for w in kept]).unionByName(crossed)


def pool_sizes(names: DataFrame) -> DataFrame:
    """Per kind the pairs ``n`` of its pool with each name, and the distinct commands and instructions among them.

    Equal names are crossed once. Texts are told apart in tasks of about TEXTS_A_TASK, so no task's memory
    grows with the names.
    """
    pools = named_pool(names.groupBy("name").agg(F.count(F.lit(1)).alias("weight")), "weight")
    texts = pools.select("kind", "weight", F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("text")) for c in ("command", "instruction")])))
    named = sum(r[3] for r in container_patterns())
    tasks = 1 + 2 * named * names.count() // TEXTS_A_TASK
    key = ("kind", "what", "text")
    seen = texts.repartition(tasks, *key).groupBy(*key).agg(F.sum("weight").alias("weight"))
    command, instruction = (F.col("what") == c for c in ("command", "instruction"))
    return seen.groupBy("kind").agg(
        F.sum(F.when(command, F.col("weight"))).alias("n"), F.count(F.when(command, F.col("text"))).alias("n_commands"), F.count(F.when(instruction, F.col("text"))).alias("n_instructions")
    )


def sample_pools(pools: DataFrame, shares: DataFrame, n: int, seed: str, key: Column | None = None) -> DataFrame:
    """Of each kind its share of n, or its whole pool if that is smaller, in the random order of a key (``k`` if none is given)."""
    keyed = pools.withColumn("key", F.concat_ws("|", "kind", F.col("k").cast("string")) if key is None else key)
    return quota_sample(keyed, "kind", "key", quota_plan(shares, n).select("kind", "quota"), seed).drop("key")


def draw(seed: str, n: Column, *cols: Column) -> Column:
    """A number from 0 below n, by hash."""
    return F.floor(unit_hash(F.lit(seed), *cols) * n).cast("int")


def draw_templates(templates: DataFrame, shares: DataFrame, n: int, slots: dict[str, tuple[str, ...]] = SLOTS, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Examples by quota, with replacement: a template and a value for each slot, and a shifted confidence.

    templates: ``kind``, ``t`` (from 0), ``pattern``, ``command``, ``base``, ``explanation``. tables: values of
    further slots, numbered from 0 by ``k``, as tables of any size.
    """
    spark, tables = templates.sparkSession, tables or {}
    counts = templates.groupBy("kind").agg(F.count(F.lit(1)).alias("n_templates"))
    plan = quota_plan(shares, n).filter("quota > 0").join(counts, "kind").collect()  # a row for each kind
    parts = [spark.range(r["quota"]).select(F.lit(r["kind"]).alias("kind"), F.lit(r["n_templates"]).alias("n_templates"), F.col("id").cast("int").alias("i")) for r in plan]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "kind string, n_templates long, i int")
    key = (F.col("kind"), F.col("i"))
    rows = rows.withColumn("t", draw("t", F.col("n_templates"), *key)).join(templates, ["kind", "t"])
    values = {s: F.get(F.array(*map(F.lit, v)), draw(s, F.lit(len(v)), *key)) for s, v in slots.items() if s not in tables}
    for s, given in tables.items():
        side = given.select(F.col("k").cast("int").alias(f"_k_{s}"), F.col("value").alias(f"_{s}"))
        rows = rows.join(side, draw(s, F.lit(given.count()), *key) == F.col(f"_k_{s}"))
        values[s] = F.col(f"_{s}")
    low, high = JITTER
    shift = low + (high - low) * unit_hash(F.lit("c"), *key)
    filled = [fill(F.col(c), **values).alias(c2) for c, c2 in (("pattern", "instruction"), ("command", "command"), ("explanation", "explanation"))]
    return rows.select("kind", "i", *filled, (F.col("base") + shift).alias("confidence"))


def write_corpus(corpus: DataFrame, path: str, seed: str, *keys: str) -> None:
    """The examples as JSON lines in a shuffled order, in files of bounded size."""
    files.write_jsonl(corpus.orderBy(order_key(seed, *[F.col(k) for k in keys]), *keys).select("instruction", "input", "output"), path)


def explode_pool(pools: DataFrame, key: str, configs: str) -> DataFrame:
    """A row for each valid configuration of each key (an array of structs)."""
    return pools.select(key, F.inline(configs))


def take_some(df: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """k rows without replacement, in random order."""
    return df.orderBy(order_key(seed, F.col(key)), key).limit(k)
