"""Tables of the library's kinds, derived from the given star-schema tables by the same SQL in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nlimorph.functions.settle import settled
from nlimorph.sources.scratch import new_folder

ROW_KEY = "l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey||'-'||cast(cast(l_shipdate as date) as string)"
DATASET = "case l_orderkey % 5 when 0 then 'snli' when 1 then 'mnlim' when 2 then 'mnlimm' when 3 then 'sick' else 'rte' end"
SAMPLES = f"""
select {ROW_KEY} as row_key,
  {DATASET} as dataset,
  case l_orderkey % 5 when 0 then 'snli' when 1 then 'mnlim' when 2 then 'mnlimm' when 3 then 'sick' else 'rte' end as source_file,
  case when l_orderkey % 5 = 4 then 'nli-binary' else 'nli' end as task,
  cast(l_orderkey as string) as pair_key,
  case l_linenumber when 1 then 'none' when 2 then 'negation_flip' when 3 then 'antonym_substitution'
    when 4 then 'synonym_replacement' when 5 then 'voice_switch' when 6 then 'conditional_clause' else 'uninformative' end as mr_id,
  cast(l_suppkey % 3 as int) as label,
  true as label_is_int,
  'Part '||l_partkey||' is supplied by '||l_suppkey as premise,
  'The order holds '||cast(l_quantity as int)||' items, flag '||l_returnflag as hypothesis,
  cast(l_quantity as bigint) as prompt_tokens,
  cast(l_linenumber as bigint) as completion_tokens
from lineitem"""

#: Replies that reach each branch of the rules.
REPLIES = {
    "0": "entailment", "1": "Neutral.", "2": "contradiction", "3": "not_entailment", "4": "Not entailment!", "5": "Entailed", "6": "The answer is neutral", "7": " e ",
    "8": "1", "9": "C", "a": "contradictory", "b": "I cannot tell", "c": "", "d": "entailment, not contradiction", "e": "2", "f": "neutral or entailment",
}

#: What stands before and after these, by further digits; with a number behind, some thousand replies differ.
BEFORE = {"0": "Not ", "1": "The answer: ", "2": "  ", "3": "i think it is ", "4": "NO, ", "5": "(", "6": "not_", "7": "2 "}
AFTER = {"0": ".", "1": "!?", "2": ",", "3": " .", "4": " or neutral", "5": " not entailed", "6": "\n", "7": "-ish"}


def _choice(digit: str, table: dict[str, str], otherwise: str) -> str:
    quoted = {d: t.replace("\n", "'||chr(10)||'") for d, t in table.items()}
    return f"case {digit} " + " ".join(f"when '{d}' then '{t}'" for d, t in quoted.items()) + f" else {otherwise} end"


_reply = f"""{_choice("before", BEFORE, "''")}||case when shout = '0' then upper({_choice("digit", REPLIES, "''")}) else {_choice("digit", REPLIES, "''")} end||{_choice("after", AFTER, "case when after = '8' then ' in case '||prompt_tokens||'/'||pair_key else '' end")}"""
PREDICTIONS = f"""
select row_key, dataset, pair_key, mr, task, premise, hypothesis, label, status, gold, {_reply} as reply, prompt_tokens, completion_tokens,
  case when prompt_tokens % 2 = 0 then prompt_tokens // 2 else 0 end as cached_tokens, true as has_usage
from (select *, substr(md5('r|'||row_key),1,1) as digit, substr(md5('r|'||row_key),2,1) as before, substr(md5('r|'||row_key),3,1) as after, substr(md5('r|'||row_key),4,1) as shout,
  case when substr(md5('n|'||row_key),1,2) <> '00' then mr_id end as mr,
  case when substr(md5('s|'||row_key),1,1) = '0' then 0 else 200 end as status,
  case when dataset = 'rte' then case when label = 0 then 'entailment' else 'not_entailment' end
       when label = 0 then 'entailment' when label = 1 then 'neutral' when substr(md5('g|'||row_key),1,1) = '0' then 'contradictory' else 'contradiction' end as gold
  from samples where mr_id <> 'none') q"""

EXPERIMENTS = ("mettrain_small_one", "mettrain_small_two", "original_full_one", "original_full_two")
SEEDS = (42, 43, 44)
RESULTS = f"""
select experiment, seed, case when substr(md5('t|'||row_key),1,1) < '8' then 'original' else 'mr' end as test_type, dataset,
  substr(md5(experiment||'|'||seed||'|'||row_key),1,1) < 'c' as correct, substr(md5('m|'||experiment||'|'||seed||'|'||row_key),1,2) = '00' as malformed
from predictions cross join (values {", ".join(f"('{e}')" for e in EXPERIMENTS)}) e(experiment) cross join (values {", ".join(f"({s})" for s in SEEDS)}) s(seed)
where not (experiment = 'original_full_one' and seed = 43 and dataset = 'rte')"""

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table dealt evenly by the hash of its keys: files of few row groups are read by few tasks, which then would do all that follows."""
    return table(spark, sf_dir, name).repartition(*keys)


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    for name in frames:
        text = text.replace(f"from {name}", f"from {{{name}}}")
    return spark.sql(text.replace(" // ", " div "), **frames)


_kept: dict[tuple[str, str], str] = {}


def keep(spark: SparkSession, sf_dir: str) -> None:
    """Write the derived tables out; from now on they are read, as a user reads tables of their own."""
    for make in (samples, predictions, results):
        path = new_folder(spark, make.__name__)
        make(spark, sf_dir).write.parquet(path)
        _kept[sf_dir, make.__name__] = path


def _kept_or(spark: SparkSession, sf_dir: str, name: str, text: str, of: Callable[[], dict[str, DataFrame]]) -> DataFrame:
    path = _kept.get((sf_dir, name))
    return spark.read.parquet(path) if path else _sql(spark, text, **of())


def samples_of(lineitem: DataFrame, *more: str) -> DataFrame:
    """The samples of some rows like those of lineitem, with more columns of theirs."""
    return _sql(lineitem.sparkSession, SAMPLES.replace("\nfrom lineitem", "".join(f", {c}" for c in more) + "\nfrom lineitem"), lineitem=lineitem)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_or(spark, sf_dir, "samples", SAMPLES, lambda: {"lineitem": dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_or(spark, sf_dir, "predictions", PREDICTIONS, lambda: {"samples": samples(spark, sf_dir)})


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the digest that tells the test type is made once a prediction, not once for each of its results
    text = RESULTS.replace("substr(md5('t|'||row_key),1,1)", "t").replace("from predictions cross join", "from (select *, substr(md5('t|'||row_key),1,1) as t from predictions) p cross join")
    return _kept_or(spark, sf_dir, "results", text, lambda: {"predictions": predictions(spark, sf_dir)})


def with_sql(*names: str) -> str:
    """The same tables as common table expressions."""
    all_of = {"samples": SAMPLES, "predictions": PREDICTIONS, "results": RESULTS}
    need = []
    for n in names:
        need += {"predictions": ["samples"], "results": ["samples", "predictions"]}.get(n, []) + [n]
    return "with " + ", ".join(f"{n} as ({all_of[n]})" for n in dict.fromkeys(need))


def prediction_lines(df: DataFrame) -> DataFrame:
    """Predictions as JSON lines: an object as response, or for failed calls a string; some lines broken."""
    meta = F.struct("task", "premise", "hypothesis", F.col("gold").alias("gold_label"))
    usage = F.struct("prompt_tokens", "completion_tokens", F.struct("cached_tokens").alias("prompt_tokens_details"))
    answer = F.struct(F.array(F.struct(F.struct(F.col("reply").alias("content")).alias("message"))).alias("choices"), usage.alias("usage"))
    good = F.to_json(F.struct("status", meta.alias("meta"), answer.alias("response")))
    failed = F.to_json(F.struct("status", meta.alias("meta"), F.lit("no answer").alias("response")))
    line = F.when(F.col("status") == 200, good).otherwise(failed)
    rows = settled(settled(df, "_line", line), "_broken", F.substring(F.md5(F.concat(F.lit("j|"), "row_key")), 1, 1))  # made once, each in code of its own
    line, broken = F.col("_line"), F.col("_broken")
    return rows.select("row_key", "dataset", "mr", F.when(broken == "0", F.concat(line, F.lit(" tail"))).when(broken == "1", F.lit("  ")).otherwise(line).alias("value"))


def stand_in():
    """A model that replies by the prompt's length: the first or the last label it names."""
    return lambda batch: ["entailment" if len(p) % 2 == 0 else p.rstrip(".").split(" ")[-1] for p in batch]
