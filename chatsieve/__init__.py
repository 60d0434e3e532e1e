"""chatsieve: Spark-native preparation and scoring of conversational training data.

Every public function takes and returns DataFrames (or Columns) and is built
from built-in Spark expressions, so Catalyst plans the whole job and the same
code runs on a laptop or a cluster.

Sub-packages
------------
functions   Column expressions (Unicode trim, whitespace, n-grams, keyword rules).
sources     Readers and writers (JSON lines, ordered text, run summaries, logs,
            CSV / Markdown reports).
operators   DataFrame -> DataFrame operators: cleaning, dataset building,
            preference pairs, token sequences, rule scoring, metrics, run tables.
plans       The registered queries over the shared test tables and their SQL
            oracles.
streaming   Incremental scoring of prediction files as they arrive.
"""

from chatsieve.session import get_session, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_session", "ensure_checkpoint_dir"]
