"""Texts, patterns, defaults and contracts that results depend on."""

# --- Fixed values: text patterns and word lists --------------------------------------

# Characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Tags of model output: header of a channel and end of a channel. (?s) lets a dot match
# newlines, (?U) makes \w Unicode.
HEADER_PATTERN = r"(?sU)<\|channel\|>(\w+)<\|message\|>"
END_PATTERN = r"<\|(?:end|return)\|>"

# "Answer: B"; the space class is the one of Python's \s.
ANSWER_PATTERN = r"(?U)[Aa]nswer[\s\x1c-\x1f]*:[\s\x1c-\x1f]*([ABCD])"
CHOICES = ["A", "B", "C", "D"]
NO_CHOICE = "?"

LEVELS = ["low", "medium", "high"]
LEVEL_MESSAGE = "Reasoning: "
EVAL_INSTRUCTION = (
    "You are GPT-OSS. Please refrain from using Markdown formatting in your response and "
    "respond in plain text. Your final response should contain the correct answer according "
    "to the example shown in each prompt. Reasoning: "
)
TRAIN_INSTRUCTION = "Write the LaTeX representation for this image."

# Number texts as Python reads them; a float is only tried when there is a dot.
INTEGER_PATTERN = r"^[+-]?[0-9]+(_[0-9]+)*$"
DOTTED_FLOAT_PATTERN = (
    r"^[+-]?([0-9]+(_[0-9]+)*\.([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)
FLOAT_PATTERN = (
    r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$|^(?i:[+-]?(nan|inf|infinity))$"
)

# Parameters whose value may name a file to be sent as base64.
FILE_KEYS = ["image", "image_input", "file", "attachment"]

PIXEL_WORD = "pixel"
PIXEL_PREFIX = "pixel, "

RUN_STATES = ["not_started", "running", "completed", "errored"]

# Status of a listed source.
BUILT, NOT_BUILT = "built", "not built yet"

# --- Fixed values: parameter defaults per model --------------------------------------

IMAGE_DEFAULTS = {
    "sdxl": {
        "negative_prompt": "", "width": 1024, "height": 1024,
        "steps": 25, "guidance_scale": 7.5, "seed": 42,
    },
    "sdxl-spo": {
        "negative_prompt": "", "width": 1024, "height": 1024,
        "steps": 25, "guidance_scale": 5.0, "seed": 42,
    },
    "sdxl-pixel-art": {
        "negative_prompt": "3d render, realistic", "width": 1024, "height": 1024,
        "steps": 25, "guidance_scale": 1.5, "seed": 42, "lora_strength": 1.2,
    },
}
CHAT_DEFAULTS = {
    "gpt-oss-20b": {"max_tokens": 2048, "temperature": 0.7, "reasoning_level": "medium"},
    "gpt-oss-120b": {"max_tokens": 256, "temperature": 0.7, "reasoning_level": "medium"},
}
VISION_DEFAULTS = {
    "qwen3-vl": {
        "prompt": "Describe this image.", "max_tokens": 128, "temperature": 1.5, "min_p": 0.1,
    },
}
TRAIN_DEFAULTS = {
    "qwen3-vl": {
        "steps": 30, "epochs": None, "learning_rate": 2e-4, "lora_r": 16, "lora_alpha": 16,
        "batch_size": 2, "gradient_accumulation_steps": 4, "max_train_samples": None,
        "instruction": TRAIN_INSTRUCTION,
    },
}
BENCHMARK_DEFAULTS = {
    "gpt-oss-20b": {"split": "test", "max_items": 100, "reasoning_level": "low"},
}
CACHE_DEFAULTS = {"qwen3-vl": {"dataset_uri": "hf:unsloth/LaTeX_OCR"}}

# Recipe arguments that each run has of its own: data, name and output folder.
RECIPE_DATA, RECIPE_NAME, RECIPE_OUTPUT = "data_paths", "+run_name", "hydra.run.dir"
RECIPE_OUTPUT_FOLDER = "/hydra-out"

# Recipe of a full training run; values are texts, overridden by stringified parameters.
RECIPE_DEFAULTS = {
    "arch": "trm",
    "evaluators": "[]",
    "epochs": "50000",
    "eval_interval": "5000",
    "lr": "1e-4",
    "puzzle_emb_lr": "1e-4",
    "weight_decay": "1.0",
    "puzzle_emb_weight_decay": "1.0",
    "arch.L_layers": "2",
    "arch.H_cycles": "3",
    "arch.L_cycles": "6",
    "ema": "True",
}

# --- Fixed values: parameter contracts (JSON Schema draft-07) ------------------------

IMAGE_CONTRACT = {
    "type": "object",
    "properties": {
        "prompt": {"type": "string"},
        "negative_prompt": {"type": "string"},
        "width": {"type": "integer", "minimum": 64},
        "height": {"type": "integer", "minimum": 64},
        "steps": {"type": "integer", "minimum": 1},
        "guidance_scale": {"type": "number", "minimum": 0},
        "seed": {"type": "integer", "minimum": 0},
    },
    "required": ["prompt"],
    "additionalProperties": False,
}
PIXEL_CONTRACT = {
    **IMAGE_CONTRACT,
    "properties": {
        **IMAGE_CONTRACT["properties"],
        "lora_strength": {"type": "number", "minimum": 0, "maximum": 2},
    },
}
CHAT_CONTRACT = {
    "type": "object",
    "properties": {
        "messages": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "role": {"type": "string", "enum": ["system", "user", "assistant"]},
                    "content": {"type": "string"},
                },
                "required": ["role", "content"],
            },
        },
        "max_tokens": {"type": "integer", "minimum": 1},
        "temperature": {"type": "number", "minimum": 0, "maximum": 2},
        "reasoning_level": {"type": "string", "enum": ["low", "medium", "high"]},
    },
    "required": ["messages"],
    "additionalProperties": False,
}
BENCHMARK_CONTRACT = {
    "type": "object",
    "properties": {
        "split": {"type": "string", "enum": ["test", "dev"]},
        "max_items": {"type": "integer"},
        "reasoning_level": {"type": "string", "enum": ["low", "medium", "high"]},
    },
}
VISION_CONTRACT = {
    "type": "object",
    "required": ["image", "prompt"],
    "properties": {
        "image": {"type": "string"},
        "prompt": {"type": "string"},
        "lora_run": {"type": "string"},
        "max_tokens": {"type": "integer"},
        "temperature": {"type": "number"},
        "min_p": {"type": "number"},
    },
}
CACHE_CONTRACT = {"type": "object", "properties": {"dataset_uri": {"type": "string"}}}
TRAIN_CONTRACT = {
    "type": "object",
    "required": ["dataset_uri"],
    "properties": {
        "dataset_uri": {"type": "string"},
        "run_name": {"type": "string"},
        "steps": {"type": "integer"},
        "epochs": {"type": "number"},
        "max_train_samples": {"type": "integer"},
        "learning_rate": {"type": "number"},
        "lora_r": {"type": "integer"},
        "lora_alpha": {"type": "integer"},
        "batch_size": {"type": "integer"},
        "gradient_accumulation_steps": {"type": "integer"},
        "instruction": {"type": "string"},
    },
}


# File name endings of saved payloads by content type.
SUFFIXES = {
    "application/json": ".json",
    "application/pdf": ".pdf",
    "application/zip": ".zip",
    "audio/mpeg": ".mp3",
    "audio/x-wav": ".wav",
    "image/bmp": ".bmp",
    "image/gif": ".gif",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/svg+xml": ".svg",
    "image/webp": ".webp",
    "text/css": ".css",
    "text/csv": ".csv",
    "text/html": ".html",
    "text/plain": ".txt",
    "text/xml": ".xml",
    "video/mp4": ".mp4",
}
