"""Thresholds, name sets and weights that decide what a run keeps."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------
# These lists and numbers decide which files count and how scores come out, so
# they must stay exactly as they are for results to match.

MIN_SIZE_KB = 200
MIN_TOKENS = 64_000
MAX_FILE_BYTES = 1_000_000
MAX_SEQUENCE_TOKENS = 2048
ERROR_TEXT_LIMIT = 500

COUNTED_EXTENSIONS = tuple(
    """
    .py .js .jsx .ts .tsx .cpp .cc .cxx .c .h .hpp
    .java .rs .go .rb .php .swift .kt .kts .scala
    .cs .m .mm .r .R .jl .lua .sh .bash .zsh
    .pl .pm .ex .exs .erl .hrl .hs .ml .mli
    .f .f90 .f95 .v .sv .vhd .vhdl
    .sql .proto .thrift .graphql
    .html .css .scss .sass .less
    .yaml .yml .toml .json .xml .ini .cfg
    .md .rst .txt
    .cmake .make .mk
    .dockerfile
    """.split()
)

DENIED_EXTENSIONS = tuple(
    """
    .pt .pth .h5 .hdf5 .pkl .pickle .parquet .csv .tsv
    .npy .npz .safetensors .onnx .pb .tflite
    .bin .dat .db .sqlite .sqlite3
    .png .jpg .jpeg .gif .bmp .svg .ico .webp
    .mp3 .mp4 .wav .avi .mov .flv
    .zip .tar .gz .bz2 .xz .rar .7z
    .whl .egg .so .dylib .dll .exe .o .a
    .pdf .doc .docx .pptx .xls .xlsx
    .lock
    """.split()
)

PRUNED_DIRECTORIES = tuple(
    """
    .git node_modules __pycache__ venv .venv env .env
    .tox .mypy_cache .pytest_cache .ruff_cache
    dist build egg-info .eggs
    vendor third_party 3rdparty
    .idea .vscode .vs
    data datasets checkpoints weights models
    logs wandb mlruns
    """.split()
)
PRUNED_DIRECTORY_SUFFIX = ".egg-info"

LANGUAGE_EXTENSIONS = {
    "python": (".py",),
    "javascript": (".js", ".jsx", ".ts", ".tsx"),
    "c": (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp"),
    "rust": (".rs",),
}

HOST_PREFIX = "https://github.com/"

STATUS_COMPLETED = "completed"
STATUS_NO_METADATA = "github_api_failed"
STATUS_SKIPPED = "skipped"
STATUS_NO_SNAPSHOT = "clone_failed"
STATUS_ERROR = "error"
NO_SNAPSHOT_TEXT = "shallow clone failed"


@dataclass(frozen=True)
class ScoreWeights:
    """Weights of the four score terms (fixed values by default)."""

    density: float = 0.25
    in_degree: float = 0.25
    largest_component: float = 0.30
    edges_per_node: float = 0.20


# --- End of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """All the knobs of one run; the defaults are the fixed values above."""

    min_size_kb: int = MIN_SIZE_KB
    min_tokens: int = MIN_TOKENS
    max_file_bytes: int = MAX_FILE_BYTES
    counted_extensions: tuple[str, ...] = COUNTED_EXTENSIONS
    denied_extensions: tuple[str, ...] = DENIED_EXTENSIONS
    pruned_directories: tuple[str, ...] = PRUNED_DIRECTORIES
    weights: ScoreWeights = field(default_factory=ScoreWeights)
    # "drop" ignores relative Python imports; "resolve" follows them.
    relative_imports: str = "drop"
    # None counts with the built-in pattern; otherwise a Column -> Column
    # function such as functions.tokens.encoder_counter(...).
    token_counter: object | None = None
    # Outcomes a later run may take up again (none: every stored row is final).
    retry_statuses: tuple[str, ...] = ()
    # Number of buckets the file table was packed in, if it was.
    file_buckets: int | None = None

    @property
    def counter_name(self) -> str:
        """Name of the token counter, written beside the counts."""
        return "pattern" if self.token_counter is None else getattr(self.token_counter, "__name__", "custom")

    def __post_init__(self):
        if self.relative_imports not in ("drop", "resolve"):
            raise ValueError("relative_imports must be 'drop' or 'resolve'")
