"""Directive lines of running tasks: parsing, redaction, status folds and environment stacks, in batch and as streams.

A line is ``<prefix><kind>: <payload>``. Parsing is stateless and native. Redaction needs what a session has declared secret
so far: in a batch parts of a session's lines meet its declarations, in a stream they are keyed state.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The wire format of directive lines.
PREFIX = "openjd_"
KINDS = ("progress", "status", "fail", "env", "redacted_env", "unset_env", "session_runtime_loglevel")
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40}
MASK = "********"
PROGRESS_ERROR = "Progress must be a floating point value between 0.0 and 100.0, inclusive."
SET_ERROR = "Failed to parse environment variable assignment."
UNSET_ERROR = "Failed to parse environment variable name."
_SPACE = r"[\s\u0085 ]"


def parse(lines: DataFrame, redactions: bool = True, echo: bool = False, line: str = "line") -> DataFrame:
    """Add to each line: ``kind`` (null for plain lines), ``payload``, ``number`` (progress or log level), ``name`` and ``value``
    (environment), ``error``, ``cancel`` (whether the action is cancelled), ``fails`` and ``passes`` (whether the line is shown).

    Wrong progress is shown with its error; wrong environment lines and near misses (another case, leading space, no space
    after the colon) cancel; a wrong redacted line cancels only where redactions are off.
    """
    text = F.col(line)
    pattern = rf"(?s)^{PREFIX}({'|'.join(KINDS)}): (.+)\z"
    kind = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
    payload = F.when(kind.isNotNull(), F.regexp_extract(text, pattern, 2))
    out = lines.withColumn("kind", kind).withColumn("payload", payload)
    k, p = F.col("kind"), F.col("payload")
    bare, led = F.regexp_replace(p, rf"^{_SPACE}+|{_SPACE}+\z", ""), F.regexp_replace(p, rf"^{_SPACE}+", "")
    number = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), bare.try_cast("double"))
    progress = F.when(number.between(0.0, 100.0), number)
    level = F.lit(None).cast("double")
    for word, n in LEVELS.items():
        level = F.when(F.upper(bare) == word, F.lit(float(n))).otherwise(level)
    setting = k.isin("env", "redacted_env")
    decoded = F.when(F.startswith(led, F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), led, F.lit("}")), "v string", {"allowUnquotedControlChars": "false"})["v"]).otherwise(led)
    good = led.rlike(r'^"?[A-Za-z_][A-Za-z0-9_]*=[^\n]*$') & decoded.isNotNull() & F.contains(decoded, F.lit("="))
    at = F.instr(decoded, F.lit("="))
    name = F.when(setting & good, F.substring(decoded, F.lit(1), at - 1)).when((k == "unset_env") & led.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), led)
    value = F.when(setting & good, F.substring(decoded, at + 1, F.length(decoded)))
    near = text.rlike(rf"(?i)^{_SPACE}*{PREFIX}(?:redacted_|unset_)?env(?:[: ]|\z)")
    error = (
        F.when((k == "progress") & progress.isNull(), F.lit(PROGRESS_ERROR))
        .when(setting & ~F.coalesce(good, F.lit(False)), F.lit(SET_ERROR))
        .when((k == "unset_env") & name.isNull(), F.lit(UNSET_ERROR))
        .when(k.isNull() & near, F.concat(F.lit("Incorrectly formatted env command ("), text, F.lit(")")))
    )
    out = out.withColumn("number", F.when(k == "progress", progress).when(k == "session_runtime_loglevel", level)).withColumn("name", name).withColumn("value", value).withColumn("error", error)
    e = F.col("error")
    cancel = F.coalesce(e.isNotNull() & ~(k == "progress") & ~((k == "redacted_env") & F.lit(redactions)), e.isNotNull())
    return out.withColumn("cancel", F.coalesce(cancel, F.lit(False))).withColumn("fails", F.coalesce(k == "fail", F.lit(False)) | (k.isNull() & e.isNotNull())).withColumn("passes", k.isNull() | (e.isNotNull() & (k != "redacted_env")) | F.lit(echo))


# -- redaction --------------------------------------------------------------------------------------------------------
def secrets_of(name_value: str | None, payload: str) -> tuple[list[str], list[str]]:
    """(texts to mask anywhere, whole lines to mask) that a redacted line declares; the value, and the lines it consists of."""
    if name_value is None:
        _, eq, rest = payload.lstrip().partition("=")
        text = rest if eq else payload.lstrip()
        return ([text] if text else []), []
    parts = name_value.split("\n")
    inner = [p for p in parts[1:-1] if p]
    return [p for p in dict.fromkeys([name_value, parts[0], parts[-1]]) if p], inner


def redact(text: str, values: list[str], lines: list[str]) -> str:
    """Mask every occurrence of the values, overlapping ones as one; a line that is itself secret is masked whole."""
    if text in lines:
        return MASK
    spans = []
    for v in values:
        at = text.find(v)
        while v and at >= 0:
            spans.append((at, at + len(v)))
            at = text.find(v, at + 1)
    return covered(text, spans)


def covered(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with a mask in place of each stretch that spans cover; spans that touch are one."""
    merged: list[list[int]] = []
    for a, z in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    for a, z in reversed(merged):
        text = text[:a] + MASK + text[z:]
    return text


def redact_env_line(text: str, payload: str) -> str:
    """A redacted line as it is shown: up to the equals sign, or up to the payload."""
    body = payload.lstrip()
    at = max(text.find(body), 0)
    return text[: at + body.index("=") + 1] + MASK if "=" in body else text[:at] + MASK


#: Lines of a session that are masked together.
LINES = 1 << 14


class Masks:
    """One automaton for the secrets that a session declares, each from the place on where it was declared first."""

    def __init__(self, declared: list[tuple]):
        import ahocorasick

        self.lines: dict[str, int] = {}
        since: dict[str, int] = {}
        for at, value, payload in declared:
            at = float("-inf") if at is None else at
            values, lines = secrets_of(value, payload)
            for known, found in ((since, values), (self.lines, lines)):
                for x in found:
                    known[x] = min(at, known.get(x, at))
        self.machine = ahocorasick.Automaton()
        for x, at in since.items():
            self.machine.add_word(x, (at, len(x)))
        if since:
            self.machine.make_automaton()
        self.empty = not since

    def mask(self, text: str, at: int) -> str:
        """:func:`redact` with what was declared before ``at``."""
        if self.lines.get(text, at) < at:
            return MASK
        spans = [] if self.empty else [(end + 1 - size, end + 1) for end, (since, size) in self.machine.iter(text) if since < at]
        return covered(text, spans)


def redacted(parsed: DataFrame, session: str = "session_id", order: str = "seq", line: str = "line") -> DataFrame:
    """Add ``shown``: each line as it is shown, with the secrets that its session declared before it masked.

    Sessions without a secret are not moved. Lines of the others are dealt into parts of some LINES lines, so that no task needs a whole session; a part gets the
    session's secrets once, as one automaton, whatever their number. Repeated lines are shown each; lines without a session share
    one. A null line is shown as null; one without a place
    comes first, so that it is shown as it is and a secret without one masks all lines that have a place.
    """
    message = F.when(F.col("error").isNotNull() & F.col("passes"), F.concat(F.col(line), F.lit(" -- ERROR: "), F.col("error"))).otherwise(F.col(line))
    told = parsed.withColumn("shown", message)
    secret = F.col("kind") == "redacted_env"
    sizes = parsed.groupBy(F.col(session).alias("_s")).agg(F.count("*").alias("_n"), F.bool_or(F.coalesce(secret, F.lit(False))).alias("_secret")).where("_secret")
    sizes = sizes.select("_s", F.ceil(F.col("_n") / LINES).cast("int").alias("_parts"))
    same = F.col(session).eqNullSafe(F.col("_s"))
    dealt = told.join(sizes, same).withColumn("_part", F.pmod(F.xxhash64(order, line), F.col("_parts")).cast("int")).drop("_s", "_parts")
    declared = parsed.where(secret).join(sizes, same).select(F.col("_s").alias("_of"), F.col(order).alias("_at"), F.col("value").alias("_value"), F.col("payload").alias("_payload"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_copy"))

    def run(lines: pa.Table, secrets: pa.Table) -> pa.Table:
        masks = Masks(list(zip(*[secrets[c].to_pylist() for c in ("_at", "_value", "_payload")], strict=True)))
        out = []
        for text, kind, payload, at, own in zip(*[lines[c].to_pylist() for c in ("shown", "kind", "payload", order, line)], strict=True):
            if kind == "redacted_env":
                out.append(redact_env_line(own, payload))
            else:
                out.append(text if text is None or at is None else masks.mask(text, at))
        return lines.drop_columns(["shown", "_part"]).append_column("shown", pa.array(out, pa.string()))

    masked = dealt.groupBy(session, "_part").cogroup(declared.groupBy("_of", "_copy")).applyInArrow(run, told.schema)
    return told.join(sizes, same, "left_anti").union(masked.select(told.columns))


def mask_command(text: Column, values: list[str]) -> Column:
    """A command line with known secrets masked, the longest first."""
    out = text
    for v in sorted(filter(None, values), key=len, reverse=True):
        out = F.replace(out, F.lit(v), F.lit(MASK))
    return out


# -- folds ------------------------------------------------------------------------------------------------------------
def action_status(parsed: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """The status of each session after its last line: latest progress, status, fail message and log level, whether it was
    cancelled, and how it would end with exit code 0."""
    last = lambda value, when: F.max_by(value, F.when(when, F.col(order)))
    k = F.col("kind")
    out = parsed.groupBy(session).agg(
        last(F.col("number"), (k == "progress") & F.col("number").isNotNull()).alias("progress"),
        last(F.col("payload"), k == "status").alias("status_message"),
        last(F.coalesce("error", "payload"), F.col("fails")).alias("fail_message"),
        F.coalesce(last(F.col("number"), (k == "session_runtime_loglevel") & F.col("number").isNotNull()), F.lit(20.0)).cast("int").alias("log_level"),
        F.bool_or("cancel").alias("cancelled"),
    )
    return out.withColumn("state", F.when(F.col("cancelled"), "CANCELED").when(F.col("fail_message").isNotNull(), "FAILED").otherwise("SUCCESS"))


def environment(parsed: DataFrame, base: DataFrame | None = None, session: str = "session_id", order: str = "seq") -> DataFrame:
    """(session, name, value): variables after the last line. Later settings replace earlier ones and ``base`` (session, name,
    value); unset names go."""
    rows = parsed.where("kind in ('env', 'redacted_env', 'unset_env') and name is not null").select(session, "name", F.when(F.col("kind") != "unset_env", F.col("value")).alias("value"), F.col(order).alias("_at"))
    if base is not None:
        rows = rows.union(base.select(session, "name", "value", F.lit(None).cast("long").alias("_at")))
    latest = rows.groupBy(session, "name").agg(F.max_by(F.struct("value"), F.coalesce("_at", F.lit(-(1 << 62)))).alias("v"))
    return latest.select(session, "name", "v.value").where("value is not null")


def layered(layers: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """For a stack of layers (by, position, name, value): add ``current``, the value that a name has from each layer on; null is
    unset."""
    w = Window.partitionBy(*by, "name").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return layers.withColumn("current", F.last("value").over(w))


#: States of a session and of an action.
SESSION_STATES = ("READY", "RUNNING", "CANCELING", "READY_ENDING", "ENDED")
ACTION_STATES = ("RUNNING", "CANCELED", "TIMEOUT", "FAILED", "SUCCESS")


class SessionMachine:
    """The states of a session over events (what, name): environments are entered in order and left in reverse; a failed or
    cancelled action leaves only exits open."""

    def __init__(self):
        self.state, self.stack, self.running = "READY", [], None

    def event(self, what: str, name: str | None = None) -> str:
        if what == "enter":
            self._need("READY", what)
            if name in self.stack:
                raise ValueError(f"environment '{name}' is entered already")
            self.stack.append(name)
            self.state, self.running = "RUNNING", "enter"
        elif what == "run":
            self._need("READY", what)
            self.state, self.running = "RUNNING", "run"
        elif what == "exit":
            if self.state not in ("READY", "READY_ENDING"):
                raise ValueError(f"cannot {what} while {self.state}")
            if not self.stack or self.stack[-1] != name:
                raise ValueError(f"environment '{name}' is not the one entered last")
            self.stack.pop()
            self.state, self.running = "RUNNING", "exit"
        elif what == "cancel":
            self._need("RUNNING", what)
            self.state = "CANCELING"
        elif what in ("success", "failed", "canceled", "timeout"):
            if self.state not in ("RUNNING", "CANCELING"):
                raise ValueError(f"no action runs while {self.state}")
            ending = what != "success" or self.running == "exit" or self.state == "CANCELING"
            self.state, self.running = ("READY_ENDING" if ending else "READY"), None
        elif what == "end":
            if self.state in ("RUNNING", "CANCELING"):
                raise ValueError(f"cannot {what} while {self.state}")
            self.state = "ENDED"
        else:
            raise ValueError(f"unknown event {what!r}")
        return self.state

    def _need(self, state: str, what: str) -> None:
        if self.state != state:
            raise ValueError(f"cannot {what} while {self.state}")


def session_states(events: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Fold events (session, seq, what, name) to (session, seq, state, error), one session at a time in order."""
    schema = f"{session} {dict(events.dtypes)[session]}, {order} {dict(events.dtypes)[order]}, state string, error string"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        machine, out = SessionMachine(), []
        for r in part.sort_values(order, kind="stable").itertuples(index=False):
            error = None
            try:
                machine.event(r.what, r.name if isinstance(r.name, str) else None)
            except ValueError as e:
                error = str(e)
            out.append((getattr(r, session), getattr(r, order), machine.state, error))
        return pd.DataFrame(out, columns=[session, order, "state", "error"])

    return events.select(session, order, "what", "name").groupBy(session).applyInPandas(fold, schema)


# -- rates ------------------------------------------------------------------------------------------------------------
RATE_SECONDS = 12.0
#: Windows a bucket of time spans.
BUCKET_WINDOWS = 32


def sliding_rate(samples: DataFrame, by: str, time: str, amount: str, window: float = RATE_SECONDS) -> DataFrame:
    """Add ``rate`` to samples (by, seconds, running amount): the slope from the last sample at or before the window's start, or from
    (0, 0) where there is none, to the sample; 0 where no time has passed. Of samples at one time the largest amount counts as the
    last. A null time or amount gives a null rate and is no start; a null ``by`` is a group.

    A group is cut into buckets of time, so no task holds one. A bucket gets the samples of one window before it, and the last sample
    before those, which is carried over from bucket to bucket in a table that has one row a bucket.
    """
    width = BUCKET_WINDOWS * window
    t, v = F.col(time).cast("double"), F.col(amount).cast("double")
    held = samples.select(by, time, amount).withColumns({"_t": t, "_v": v, "_b": F.floor(t / width), "_own": F.lit(True)})
    good = F.col("_t").isNotNull() & F.col("_v").isNotNull()
    point = F.struct("_t", "_v")
    # the last sample of each bucket, and its last one at or before one window from the bucket's end
    ends = held.where(good).groupBy(by, "_b").agg(F.max(point).alias("all"), F.max(F.when(F.col("_t") <= (F.col("_b") + 1) * width - window, point)).alias("head"))
    w = Window.partitionBy(by).orderBy("_b")
    carried = ends.withColumns({"_c": F.lead("_b").over(w), "before": F.lag("all").over(w)})
    near = F.col("_c") == F.col("_b") + 1
    carried = carried.where("_c is not null").select(F.col(by).alias("_by"), "_c", F.when(near, F.coalesce("head", "before")).otherwise(F.col("all")).alias("_carried"))
    late = held.where(good & (F.col("_t") > (F.col("_b") + 1) * width - window)).withColumns({"_b": F.col("_b") + 1, "_own": F.lit(False)})
    both = held.union(late)
    joined = both.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_c")), "left")
    last = F.expr(f"max(if(_t is null or _v is null, null, struct(_t, _v))) over (partition by {by}, _b order by _t range between unbounded preceding and {window!r}D preceding)")
    start = F.coalesce(last, F.col("_carried"), F.struct(F.lit(0.0).alias("_t"), F.lit(0.0).alias("_v")))
    out = joined.withColumn("_from", start).where("_own")
    span = F.col("_t") - F.col("_from._t")
    return out.select(by, time, amount, F.when(good, F.when(span > 0, (F.col("_v") - F.col("_from._v")) / span).otherwise(0.0)).alias("rate"))


# -- streams ----------------------------------------------------------------------------------------------------------
STATUS = "session_id string, seq long, progress double, status_message string, fail_message string, log_level int, cancelled boolean, shown string"
_STATE = "progress double, status_message string, fail_message string, log_level int, cancelled boolean, secrets string"


def status_stream(lines: DataFrame, redactions: bool = True, every_line: bool = False) -> DataFrame:
    """A stream of (session_id, seq, line) to the sessions' statuses: after each batch one row a session that had lines, or
    (``every_line``) one row a line with its redacted text. State is one small row a session: the status and its secrets."""
    parsed = parse(lines, redactions)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        progress, status, failed, level, cancelled, secrets = state.get if state.exists else (None, None, None, 20, False, "[[],[]]")
        values, whole = json.loads(secrets)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out, seq = [], None
        for r in rows.itertuples(index=False):
            seq = int(r.seq)
            kind = r.kind if isinstance(r.kind, str) else None
            number = float(r.number) if r.number is not None and r.number == r.number else None
            if kind == "progress" and number is not None:
                progress = number
            elif kind == "status":
                status = r.payload
            elif kind == "session_runtime_loglevel" and number is not None:
                level = int(number)
            if r.fails:
                failed = r.error if isinstance(r.error, str) else r.payload
            cancelled = bool(cancelled or r.cancel)
            if kind == "redacted_env":
                v, ls = secrets_of(r.value if isinstance(r.value, str) else None, r.payload)
                values, whole = list(dict.fromkeys(values + v)), list(dict.fromkeys(whole + ls))
                shown = redact_env_line(r.line, r.payload)
            else:
                message = f"{r.line} -- ERROR: {r.error}" if isinstance(r.error, str) and r.passes else r.line
                shown = redact(message, values, whole)
            if every_line:
                out.append((key[0], seq, progress, status, failed, level, cancelled, shown))
        state.update((progress, status, failed, level, cancelled, json.dumps([values, whole])))
        if not every_line:
            out = [(key[0], seq, progress, status, failed, level, cancelled, None)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATUS.split(", ")])

    columns = ["session_id", "seq", "line", "kind", "payload", "number", "value", "error", "cancel", "fails", "passes"]
    return parsed.select(*columns).groupBy("session_id").applyInPandasWithState(fold, STATUS, _STATE, "append", "NoTimeout")


_RATE_STATE = T.StructType([T.StructField("times", T.ArrayType(T.DoubleType())), T.StructField("amounts", T.ArrayType(T.DoubleType())), T.StructField("waiting_times", T.ArrayType(T.DoubleType())), T.StructField("waiting_amounts", T.ArrayType(T.DoubleType()))])


def rate_stream(samples: DataFrame, by: str, at: str, amount: str, window: float = RATE_SECONDS, delay: str = "10 seconds", forget: float | None = None) -> DataFrame:
    """:func:`sliding_rate` over a stream of samples (by, at: timestamp, running amount), in seconds since 1970: (by, seconds, amount, rate),
    one row a sample, once the watermark (``delay`` behind the latest sample) has passed it and none before it can come any more.

    State of a key are the samples that the watermark hasn't passed, and of those before them a ring that reaches one window back.
    Samples later than the watermark are dropped. With ``forget``, a key without a sample for so many seconds of event time loses its
    ring, and starts anew from (0, 0). A stream that ends leaves the samples after its last watermark waiting.
    """
    kind = dict(samples.dtypes)[by]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, waiting = [], []
        if state.exists:
            times, amounts, w_times, w_amounts = state.get
            held, waiting = list(zip(times, amounts, strict=True)), list(zip(w_times, w_amounts, strict=True))
        for b in batches:
            if len(b):
                waiting += list(zip(b["seconds"].astype(float), b["amount"].astype(float), strict=True))
        mark = state.getCurrentWatermarkMs() / 1000
        waiting.sort()
        ready = [x for x in waiting if x[0] <= mark]
        waiting = waiting[len(ready) :]
        out = []
        for t, v in ready:
            if forget is not None and held and t - held[-1][0] > forget:
                held = []
            start = max((x for x in held if x[0] <= t - window), default=(0.0, 0.0))
            span = t - start[0]
            out.append((key[0], t, v, (v - start[1]) / span if span > 0 else 0.0))
            # of what lies before the window only the last sample can be a start again
            held = [x for x in held if x[0] > t - window or x == start] + [(t, v)]
        if held and not waiting and forget is not None and held[-1][0] + forget <= mark:
            held = []
        if held or waiting:
            state.update(([x[0] for x in held], [x[1] for x in held], [x[0] for x in waiting], [x[1] for x in waiting]))
            wake = waiting[0][0] if waiting else held[-1][0] + forget if forget is not None else None
            if wake is not None:
                state.setTimeoutTimestamp(int(max(wake, mark) * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[by, "seconds", "amount", "rate"])

    timed = samples.where(F.col(at).isNotNull() & F.col(amount).isNotNull()).withWatermark(at, delay)
    rows = timed.select(by, at, (F.unix_micros(at) / 1e6).alias("seconds"), F.col(amount).cast("double").alias("amount"))
    return rows.groupBy(by).applyInPandasWithState(fold, f"{by} {kind}, seconds double, amount double, rate double", _RATE_STATE, "append", "EventTimeTimeout")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Run a stream over what is there now, into Parquet, and end."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def malformed(text: str) -> bool:
    """Whether a plain line is a near miss of an environment directive."""
    return bool(re.match(rf"(?i)\s*{PREFIX}(?:redacted_|unset_)?env(?:[: ]|\Z)", text))
