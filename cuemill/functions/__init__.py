"""Column functions: text, model output, time and subtitles, numbers. Each takes and returns columns and stays in the JVM."""
