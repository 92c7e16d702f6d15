"""Column functions: canonical values of raw readings, and text spans with offsets."""
