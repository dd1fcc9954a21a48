"""The dimension tables that come with the engine. Each is a small DataFrame that a user may extend or replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULE = "artifact_type string, label string, glob string, required boolean, ordinal int"

#: Rights by licence id. Name, commercial use, patent grant, what it says of trademarks. All of them let works be
#: redistributed and modified and ask for attribution.
LICENCES = (
    ("apache-2.0", "Apache License 2.0", True, True, "Section 6: no trademark rights granted beyond what is needed to describe origin of the work."),
    ("mit", "MIT License", True, False, None),
    ("bsd-3-clause", "BSD 3-Clause License", True, False, "Clause 3: names of contributors may not be used to endorse derived products."),
    ("cc-by-4.0", "Creative Commons Attribution 4.0", True, False, None),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0", False, False, None),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0", True, False, None),
    ("gpl-3.0", "GNU General Public License v3.0", True, True, None),
    ("agpl-3.0", "GNU Affero General Public License v3.0", True, True, None),
    ("llama2", "Llama 2 Community License", True, False, "Meta trademarks not licensed; 'Llama' naming requirements apply to derivatives."),
    ("llama3", "Llama 3 Community License", True, False, "Meta trademarks not licensed; 'Llama' naming requirements apply to derivatives."),
    ("gemma", "Gemma Terms of Use", True, False, "Google trademarks not licensed."),
    ("openrail", "OpenRAIL", True, False, None),
)

#: What a payload of each type must or should hold, below its root. Label, whether it is required, globs.
LICENCE_FILES = ("LICENSE*", "LICENCE*", "COPYING*", "license*")
COMPLETENESS = {
    ("model", "model/"): (
        ("config", True, ("config.json", "*.gguf")),
        ("weights", True, ("*.safetensors", "*.bin", "*.gguf", "*.pt", "*.pth")),
        ("tokenizer", True, ("tokenizer.json", "tokenizer.model", "vocab.json", "spiece.model", "tiktoken.model", "*.tiktoken", "*.gguf")),
        ("model_card", False, ("README.md", "README*.md")),
        ("license", False, LICENCE_FILES),
        ("generation_config", False, ("generation_config.json",)),
        ("tokenizer_config", False, ("tokenizer_config.json",)),
    ),
    ("dataset", "data/"): (
        ("data", True, ("*.parquet", "*.jsonl", "*.json", "*.csv", "*.arrow", "*.txt", "*.tsv")),
        ("dataset_card", False, ("README.md", "README*.md")),
        ("license", False, LICENCE_FILES),
        ("dataset_infos", False, ("dataset_infos.json",)),
    ),
    ("code", "code/"): (
        ("files", True, ("*",)),
        ("readme", False, ("README.md", "README*", "readme*")),
        ("license", False, LICENCE_FILES),
    ),
}

#: What an engine looks for in a payload. Globs that all must match, globs of which one must, and the endings of
#: the architectures that it runs, if it asks for them.
CAUSAL = ("ForCausalLM", "LMHeadModel")
ENGINES = {
    "transformers": (("model/config.json",), ("model/*.safetensors", "model/*.bin", "model/*.pt", "model/*.pth"), CAUSAL),
    "llama-cpp": ((), ("model/*.gguf",), None),
    "mlx": (("model/config.json",), ("model/*.npz",), CAUSAL),
}

#: Files that say how a source tree is built or run. Label, whether only the root of the tree counts, globs.
BUILD_FILES = (
    ("container", False, ("Dockerfile", "Dockerfile.*", "*.Dockerfile", "Containerfile")),
    ("compose", False, ("compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml", "docker-compose.*.yaml", "docker-compose.*.yml")),
    ("python", False, ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "requirements-*.txt", "requirements/*.txt", "environment.yml", "environment.yaml", "uv.lock", "poetry.lock")),
    ("node", False, ("package.json",)),
    ("rust", False, ("Cargo.toml",)),
    ("go", False, ("go.mod",)),
    ("nix", False, ("flake.nix", "shell.nix", "default.nix")),
    ("make", True, ("Makefile", "makefile", "GNUmakefile", "justfile", "Justfile")),
    ("env_template", True, (".env.sample", ".env.example", ".env.template")),
    ("shell", True, ("*.sh",)),
)


def licences(spark: SparkSession) -> DataFrame:
    rows = [(key, name, commercial, True, True, True, patent, marks) for key, name, commercial, patent, marks in LICENCES]
    return spark.createDataFrame(rows, "license string, name string, commercial_use boolean, redistribution boolean, modification boolean, attribution_required boolean, patent_grant boolean, trademark_terms string")


def completeness_rows() -> list[tuple]:
    return [(kind, label, root + glob, required, n) for (kind, root), rules in COMPLETENESS.items() for n, (label, required, globs) in enumerate(rules) for glob in globs]


def completeness_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(completeness_rows(), RULE)


def engine_rows() -> list[tuple]:
    return [("model", engine, glob, required, n) for n, (engine, (every, some, _)) in enumerate(ENGINES.items()) for globs, required in ((every, True), (some, False)) for glob in globs]


def engine_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(engine_rows(), RULE)


def engine_architectures(spark: SparkSession) -> DataFrame:
    """(engine, endings): null where an engine takes any architecture."""
    return spark.createDataFrame([(engine, list(ends) if ends else None) for engine, (_, _, ends) in ENGINES.items()], "engine string, endings array<string>")


def build_rows() -> list[tuple]:
    return [("code", label, glob, False, n, root) for n, (label, root, globs) in enumerate(BUILD_FILES) for glob in globs]


def build_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(build_rows(), f"{RULE}, root boolean")
