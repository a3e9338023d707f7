"""larder — retail catalogue, deal, order and chat analytics as Spark jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function with explicit
``as_of`` / ``seed`` arguments; nothing reads the wall clock and nothing
collects data to the driver.
"""

from larder.session import AS_OF, get_session, ensure_checkpoint_dir

__all__ = ["AS_OF", "get_session", "ensure_checkpoint_dir"]
