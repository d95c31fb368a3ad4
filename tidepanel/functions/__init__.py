"""Column builders; every one of them stays inside the JVM."""
