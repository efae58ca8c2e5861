"""Column builders: numbers, text, dates, arrays. All stay in the JVM."""
