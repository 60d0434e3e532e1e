"""Default vocabularies.

Every operator takes its vocabulary as an argument; these are only the
defaults, kept together in one place.
"""

# ---------------------------------------------------------------------------
# Fixed values (must equal the original project's strings for equal results).
# ---------------------------------------------------------------------------

# The nine scene categories, in rule order (list order decides ties).
CATEGORIES = [
    "退换货场景", "物流查询场景", "签收未收到场景", "错发漏发场景",
    "商品参数场景", "质量投诉场景", "订单修改场景", "价格优惠场景", "其他咨询场景",
]

SYSTEM_PROMPT = """你是一个专业、谨慎、负责的电商客服助手。
你必须遵守以下原则：
1. 先识别场景，再给出客服回复。
2. 食品、母婴、投诉、退款、物流异常等高风险场景必须谨慎处理。
3. 不得编造商品参数、库存、快递时效、优惠金额、退款金额。
4. 不得未经核实直接承诺退款、补发、赔偿或判定丢件。
5. 食品疑似变质、有虫、发霉、异味时，应提醒用户先不要继续食用，并提供照片/视频等凭证以便售后核实。
6. 商品参数不确定时，应说明以详情页、包装标识或官方参数为准，并建议进一步核实。
输出格式必须为：
场景分类：xxx
客服回复：xxx
"""

# The published chat rows with dialogue context: system prompt, task, labels, speakers.
SERVICE_SYSTEM_PROMPT = ("你是一名专业、礼貌、遵守平台规则的电商客服助手。回答需要先安抚用户，再给出清晰、可执行的处理建议，"
                         "不能随意承诺退款、赔偿或补发。")
CONTEXT_TASK = "请根据以下电商客服对话上下文，生成一段合适、礼貌、可执行的客服回复。"
CONTEXT_SCENE_LABEL = "场景类别："
CONTEXT_LABEL = "对话上下文："
SPEAKER_NAMES = {"user": "用户", "assistant": "客服"}

# Prompt pieces.
CHOOSE_CATEGORY_PREAMBLE = "请先从以下类别中选择最合适的一个场景分类，然后给出客服回复：\n"
CATEGORY_JOINER = "、"
USER_QUESTION_LABEL = "用户问题："
CATEGORY_LABEL = "场景分类："
REPLY_LABEL = "客服回复："
# Regex for the category line of a model answer (ASCII or full-width colon).
CATEGORY_LINE_REGEX = r"场景分类[:：]\s*([^\n\r]+)"
CATEGORY_FALLBACK_CHARS = 20

# Chat-template markers.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
ALT_HEADER_MARKER = "<|start_header_id|>"
EMPTY_THINK_BLOCK = "<think>\n\n</think>\n\n"

# Label value of masked tokens and default batch padding multiple.
IGNORE_INDEX = -100
PAD_MULTIPLE = 8

# Output-field names tried in order when reading a prediction record.
OUTPUT_FIELDS = ["output", "prediction", "pred", "response", "answer", "generated_text"]

# Phrases the cleaning report names as down-weighted / removed replies.
RISKY_REPLY_PHRASES = [
    "几颗坏果是正常现象哦",
    "可以再吃吃看",
    "退亲 5 元差价可以吗",
    "直接申请退款哦",
    "找快递索赔一下哦",
]
ADDRESS_CHECK_PHRASES = ["亲请核对一下收货地址哦"]
CHITCHAT_PHRASES = ["亲亲", "嗯嗯", "好的呢"]

# Minimum effective characters of a reply: strict and relaxed variants.
STRICT_MIN_CHARS = 20
RELAXED_MIN_CHARS = 12

# Elements every chosen answer must include (preference-set quality policy).
CHOSEN_MUST_INCLUDE = ["场景分类", "客服回复", "安抚/理解", "核实/凭证/订单号或可执行步骤"]

# Run-table columns (CSV order) and Markdown header of the run comparison.
RUN_TABLE_COLUMNS = [
    "experiment", "target_preset", "target_modules", "quantization", "dtype", "rank", "lora_alpha",
    "learning_rate", "epochs", "max_steps", "train_samples", "eval_samples", "eval_loss",
    "eval_mean_token_accuracy", "train_runtime_seconds", "max_memory_allocated_gb",
    "max_memory_reserved_gb", "path",
]
RUN_TABLE_MD_HEADER = [
    "| Experiment | Target | Quant | DType | r | Eval Loss | Eval Acc | Time(s) | Max Alloc GB |",
    "|---|---:|---:|---:|---:|---:|---:|---:|---:|",
]
RANK_FALLBACK = 999
# Run-table column -> path in a run summary (same order as RUN_TABLE_COLUMNS,
# without the trailing path column).
RUN_FIELDS = [
    ("experiment", ["experiment"]), ("target_preset", ["target_preset"]),
    ("target_modules", ["target_modules"]), ("quantization", ["quantization"]), ("dtype", ["dtype"]),
    ("rank", ["rank"]), ("lora_alpha", ["lora_alpha"]), ("learning_rate", ["learning_rate"]),
    ("epochs", ["num_train_epochs"]), ("max_steps", ["max_steps"]), ("train_samples", ["train_samples"]),
    ("eval_samples", ["eval_samples"]), ("eval_loss", ["eval_metrics", "eval_loss"]),
    ("eval_mean_token_accuracy", ["eval_metrics", "eval_mean_token_accuracy"]),
    ("train_runtime_seconds", ["train_runtime_seconds"]),
    ("max_memory_allocated_gb", ["max_memory_allocated_gb"]),
    ("max_memory_reserved_gb", ["max_memory_reserved_gb"]),
]
# Preference-training series in a trainer log.
REWARD_METRICS = ["rewards/accuracies", "rewards/margins", "rewards/chosen", "rewards/rejected"]

# Comparison-table metric labels; the baseline run's win rate is 0.5.
COMPARISON_LABELS = ["BERTScore F1", "Must-have Pass", "1 - Forbidden Hit", "Win Rate"]
BASELINE_WIN_RATE = 0.5

# Side-by-side Markdown report headings.
SIDE_BY_SIDE_TITLE = "# Base Qwen3-8B vs LoRA SFT 推理对比"
SIDE_BY_SIDE_ITEM = "## 样本 {id}：{category}"
SIDE_BY_SIDE_QUESTION = "### 用户问题"
SIDE_BY_SIDE_BASE = "### Base Qwen3-8B 回答"
SIDE_BY_SIDE_CANDIDATE = "### LoRA SFT 后回答"
