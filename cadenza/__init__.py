"""cadenza: evaluation of speech-synthesis systems on matched prompts, as Spark DataFrame operators."""
