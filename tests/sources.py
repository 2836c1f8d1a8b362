"""Literal source files for the tests."""

JAVA = """// freight
package org.harbour.cargo;

import java.time.Instant;
import static java.lang.Math.max;
import org.harbour.dock.*;

public record Berth(int slot, String quay) {}

@Component
@Scope("day")
public class Crane extends Machine implements Lifter, Auditable {

    private int load;

    public Crane(int limit) {
        this.load = max(limit, 0);
    }

    @Override
    public void lift(Berth to) {
        winch.pull(to.slot());
    }
    @Override public int lost() {
        return 1;
    }
}

interface Lifter {
    void lift(Berth to);
}

enum Weather {
    CALM, STORM
}
"""

PHP = """<?php

namespace Harbour\\Tides;

use Harbour\\Clock;
use Harbour\\Maps\\Chart as Map;

function _level($at) {
    return 0;
}

#[Table("tides")]
final class TideTable extends Almanac implements Readable {
    use Cached, Logged;

    #[Slow]
    public function __construct(Clock $clock) {
    }

    protected function high(int $day) {
        $first = Map::find($day)->peak();
    }
}

trait Logged {
    public function log(string $line) {
    }
}

enum Phase: int {
    case EBB = 0;
}
"""

PYTHON = """import math
from harbour.tides import table

@register
class Buoy(Float, Lit):
    # painted red
    def __init__(self, depth):
        self.depth = math.sqrt(depth)

    @staticmethod
    async def drift(wind: float) -> float:
        return table.lookup(wind)

def _signal(kind: str = "bell") -> None:
    ring(kind)

class Anchor:
\tdef drop(self): pass
"""

RUST = """use std::fmt::Display;
pub use crate::rope;

enum Knot { Bowline, Hitch }

pub trait Tie {
    fn tie(&self, around: &str);
}

pub(crate) struct Rope {
    metres: u32,
}

impl Tie for Rope {
    pub fn splice(metres: u32) -> Rope {
        Rope { metres }
    }
}

pub async fn coil(rope: Rope) -> Rope { rope }
"""

TYPESCRIPT = """import { chart } from './charts';
const net = require("net");

export type Heading = number;

export interface Vessel extends Named {
    draught: number;
}

export const steer = (to: Heading): void => {
    chart.mark(to);
};

export abstract class Pilot extends Guide implements Vessel, Paid {
    async board(ship: Vessel): Promise<boolean> {
        return radio.call(ship);
    }
}

enum Flag { Red, Green }

export default function moor(): void {
    tie();
}
"""

GO = """// Package lock raises and lowers boats.
package lock

import (
\t"fmt"
\tgate "harbour/gate"
)

// Chamber is filled
// from above.
type Chamber struct {
\tlevel int
}

func (c Chamber) Level() int { return c.level }

type (
\tFiller interface{ Fill() error }
\tDepth  int
)

// Raise fills a chamber.
//
//go:noinline
func Raise(c *Chamber, by Depth) error {
\tif err := open(gate.Upper(c), []rune("a(b)")); err != nil {
\t\treturn fmt.Errorf("stuck: %w", err)
\t}
\t(&Chamber{}).drain(c).wait()
\treturn nil
}
"""
