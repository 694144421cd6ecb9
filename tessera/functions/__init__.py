"""Expression builders."""
